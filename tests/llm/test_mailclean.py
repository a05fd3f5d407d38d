import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import mailclean
from lodestone.llm import mailclean_kernel as k

HEAD = "Subject: x\nDate: y\n\n"
OWN = "No error is shown, the shell is simply gone."


def gone(body):
    return [(HEAD + body).split("\n")[n - 1] for n in k.cut_lines(HEAD + body)]


@pytest.mark.parametrize(
    "intro",
    [
        "On 2020-07-09 11:10, Ann Lee wrote:", "On Mon, Feb 21, 2020 at 2:18 AM Ann Lee <\nann@x.org> wrote:", "On Sat, 20 Apr 2019,\nAnn Lee wrote:", "Am Mi., 9. März 2020 um 12:31 Uhr schrieb Ann Lee <a@x.org>:",
        "Le mer. 4 mars 2020 à 06:19, Ann Lee <a@x.org> a écrit :", "El lun, 21 mar 2021 a las 7:52, Ann Lee (<a@x.org>) escribió:", "Ann Lee writes:", "Quoting Ann Lee <a@x.org>:", "* Ann Lee <a@x.org> [2019-10-27]:",
        "Ann Lee <a@x.org> wrote on 28 Sep 2021:", "At 09:33 PM 2/17/2018, Ann Lee wrote:",
    ],
)
@pytest.mark.parametrize("prefix", ["> ", ">", "| ", "&gt; ", "AL> ", "МД> ", "  > "])
def test_quotation(intro, prefix):
    quote = f"{prefix}Is it on purpose?\n{prefix}\n{prefix}> older"
    body = f"Hi Ann,\n{OWN}\n\n{intro}\n{quote}\n\n{OWN}"
    assert gone(body) == [*intro.split("\n"), *(x for x in quote.split("\n") if x.strip())]


def test_wrapped_end():
    q = "> The sign of the pulley follows the right-hand rule, so a normal marker"
    assert gone(f"{q}\nturns left so that calls stay cheap.\n> next\n{OWN}") == [q, "turns left so that calls stay cheap.", "> next"]
    assert gone(f"> The sign of the pulley follows the right-hand rule, so it stays.\n{OWN}") == ["> The sign of the pulley follows the right-hand rule, so it stays."]


def test_what_stays():
    body = ">>> import pyacme as acme\n>>> acme.AcBody(1)\n| step | node |\n| 1 | 2 |\nOn the second run the solver wrote:\n  residual 2 at step 3\nFrom: the manual I only learned little.\n    if a > 3:\n        a -= 1\ndemo --steps 3 -- --verbose > out.txt\nThanks for the answer."
    assert gone("Hello everyone,\n\n" + body) == [] and gone("Thanks Bob -\n" + body) == []


@pytest.mark.parametrize(
    "sig", ["-- \nAnn Lee\nEngineer, X University", "Kind regards\nAnn Lee\nPostdoc", "Mit freundlichen Grüßen\nAnn Lee", "Ann Lee\nPhD student\nInstitute of Machines\nP.O. Box 16, Norvik 99870\n☎ 312.555.0169", "~Ann", "/ann", "—\nAnn Lee\nE-mail: a@x.org", "Regards"]
)
def test_signature(sig):
    assert gone(f"{OWN}\n\n{sig}") == sig.split("\n")


@pytest.mark.parametrize("head", ["-----Original Message-----\nFrom: Ann Lee [mailto:a@x.org]\nSent: x\nTo: b@x.org\nSubject: z", "---------- Forwarded message ---------\nFrom: A <a@x.org>\nDate: x\nSubject: y\nTo: <b@x.org>", "Von: A <a@x.org>\nGesendet: 17. Nov 2020\nAn: b@x.org\nBetreff: z", "*From:* A\n*Sent:* x\n*To:* b\n*Subject:* z", "________________________________\nFrom: A\nSent: x\nTo: b\nSubject: z"])
def test_forwarded(head):
    assert gone(f"{OWN}\n\n{head}\n\n{OWN}\nRegards\nAnn") == [*head.split("\n"), OWN, "Regards", "Ann"]


@pytest.mark.parametrize("tail", ["Sent from my pocket device", "Legal notice:\nAny copying or passing on without consent is forbidden.", "****************************************\nNo liability is taken for damage caused by viruses.", "________________________________________\nUnsubscribe: l-off@lists.example", "You get this mail because you belong to the group \"m\".\nMembership settings are found on the group page.", "Gesendet von meinem Telefon", "Toute diffusion sans accord préalable est interdite."])
def test_tails(tail):
    assert gone(f"{OWN}\n\n{tail}") == tail.split("\n")


@pytest.mark.parametrize("line", [
    "I asked on the mailing list yesterday.", "To leave the contact unconstrained, call SetX.", "To unsubscribe the callback use Remove().", "Unsubscribe the observer before the next step.",
    "Visit the discussion of contacts in the manual.", "For more options pass a second argument.", "See the mailing list for the rest of it.", "The list archive holds an older answer.",
])
def test_own_lines_that_look_like_footers(line):
    assert gone(f"{OWN}\n{line}\n{OWN}") == [] and gone(f"{OWN}\n\n{line}\n\n{OWN}") == []
    assert gone(f"{OWN}\n{line}") == []


def test_disclaimers_stand_at_the_end():
    own = "The geometry is confidential, so I only show a sketch."
    assert gone(f"{own}\n{OWN}\n\nHere is the sketch I mean.") == []
    tail = "Confidentiality notice:\nThis message is privileged and meant only for the addressee."
    assert gone(f"{own}\n\nHere is the sketch.\n\n{tail}\n\n> quoted") == [*tail.split("\n"), "> quoted"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="> |abcAB:\n\r-_@.<", max_size=300))
def test_any_text(text):
    lines = text.split("\n")
    cut = k.cut_lines(text)
    assert cut == sorted(set(cut)) and all(2 < n <= len(lines) and lines[n - 1].strip() for n in cut)
    k.keep_text(text)


def test_frame(spark):
    rows = [(1, "forum/1", f"{HEAD}{OWN}\r\n\r\n> q\r\n", 5), (1, "forum/1", f"{HEAD}{OWN}\r\n\r\n> q\r\n", 5), (2, "forum/1", None, 5), (3, "forum/1", "", 5), (4, "a.py", "x\n\n\n> q", 5), (5, None, "> q", 5), (6, "forum/2", HEAD + "> q\n" * 20000, 1)]
    df = spark.createDataFrame(rows, "chunk_id long, path string, text string, line_no int")
    got = mailclean.removed_lines(df)
    assert got.filter("chunk_id < 6").collect() == [(1, 6), (1, 6)] and got.filter("chunk_id = 6").count() == 20000
    kept = {r["chunk_id"]: r["new_text"] for r in mailclean.newly_written(df).collect()}
    assert kept[1] == f"{HEAD}{OWN}\r" and kept[2] is None and kept[3] == "" and kept[4] is None
    assert mailclean.removed_lines(df.limit(0)).count() == 0

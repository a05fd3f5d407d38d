import zipfile

import pytest

from lodestone.__main__ import main, parser
from lodestone.config import EngineConfig
from lodestone.plans import pipeline
from lodestone.sources import archives, indexes, revisions


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "src" / "body.cpp").write_text("/** Moves it. */\nvoid Body::SetPos(double x) { pos = x; }\nclass Body { int a; };\n")
    (root / "demo.py").write_text("import os\n\ndef make_body():\n    return 1\n")
    (root / "notes.md").write_text("# Notes\nA rigid body moves.\n## Solver\nIt converges.\n")
    (root / "data").mkdir()
    (root / "data" / "x.py").write_text("left out = 1")
    return root


def test_build_merge_search(spark, tree, tmp_path, monkeypatch, capsys):
    full = str(tmp_path / "full")
    pipeline.build_tree_index(spark, str(tree), full, ref="v1.2.0")
    chunks, manifest = indexes.read(spark, full)
    rows = chunks.orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["path"], r["symbol"]) for r in rows] == [(0, "demo.py", "make_body"), (1, "notes.md", "notes.md"), (2, "src/body.cpp", "Body::SetPos"), (3, "src/body.cpp", "Body")]
    assert manifest["channel"] == "1.2.0" and manifest["n_chunks"] == "4" and manifest["dim"] == "64"
    parts = [str(tmp_path / f"s{i}") for i in range(2)]
    for i, p in enumerate(parts):
        pipeline.build_tree_index(spark, str(tree), p, shard=f"{i}/2", ref="v1.2.0")
    merged = str(tmp_path / "merged")
    with pytest.raises(ValueError):
        pipeline.merge(spark, merged, parts[:1])
    assert not indexes.exists(spark, merged)
    pipeline.merge(spark, merged, parts[::-1])
    assert indexes.read(spark, merged)[0].orderBy("chunk_id").collect() == rows
    with pytest.raises(ValueError):
        pipeline.merge(spark, merged, [full])
    text = pipeline.search_text(spark, [full], "SetPos", 3)
    assert text.startswith("Top 3 matches for 'SetPos'") and "#1  score=" in text and "src/body.cpp:1 [cpp]  Body::SetPos" in text.split("\n")[2] + text.split("\n")[3]
    assert "[low confidence]" in pipeline.search_text(spark, [full], "bread recipe")
    assert "Top 8 matches" in pipeline.search_text(spark, [full, merged], "body", 25)
    monkeypatch.setenv("LODESTONE_INDEX", full)
    monkeypatch.setenv("LODESTONE_DIGEST", str(tree / "notes.md"))
    assert main(["digest", "solver"]) == 0 and main(["digest"]) == 0 and main(["search", "make_body"]) == 0
    said = capsys.readouterr().out
    assert "## Solver\nIt converges." in said and "# Notes" in said and "demo.py:3" in said
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"query": "SetPos", "kind": "cpp", "relevant": ["body.cpp"]}\n\n{"query": "bread recipe", "kind": "negative", "relevant": []}\n{"query": "x", "kind": "cpp", "relevant": ["y"], "channels": ["other"]}\n')
    assert main(["eval", str(gold)]) == 0 and "'recall': 1.0" in capsys.readouterr().out


def test_mailbox_upsert(spark, tree, tmp_path):
    index, box = str(tmp_path / "i"), tmp_path / "m.mbox"
    pipeline.build_tree_index(spark, str(tree), index, ref="main")
    body = "Hi Bob,\n" + "the wheel slips on ice " * 100 + "\n"
    box.write_text("".join(f"From x\nSubject: Re: slip {i}\nFrom: Ann Lee <a@b.c>\nDate: Tue, 30 Jan 2024 08:33:51 +0000\nX-GM-THRID: 7\n\n{body}\n" for i in range(2)))
    for _ in range(2):
        pipeline.upsert_mailbox(spark, index, str(box), str(tmp_path / "staged"))
        chunks, manifest = indexes.read(spark, index)
        posts = chunks.filter("path = 'forum/7'").collect()
        assert len(posts) == 2 and manifest["n_chunks"] == "6" and chunks.select("chunk_id").distinct().count() == 6
        assert all("[name removed]" in p["text"] and p["language"] == "forum" for p in posts)


def test_config():
    c = EngineConfig.from_env({"LODESTONE_INDEX": "/a", "LODESTONE_EXTRA_INDEXES": "/b: :/c"})
    assert c.indexes() == ["/a", "/b", "/c"] and c.resolved_provider() == "openai"
    assert c.resolved_provider(model="claude-x") == "anthropic" and c.resolved_provider(" OpenAI ", "claude-x") == "openai"
    assert EngineConfig(base_url="http://h").resolved_provider(model="gpt") == "local" and EngineConfig(has_key=True).resolved_provider() == "anthropic"
    for bad in ("local", "other"):
        with pytest.raises(ValueError):
            c.resolved_provider(bad)
    assert parser().parse_args(["search", "a", "b", "-k", "3"]).words == ["a", "b"]


def test_archives(tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("top/x.txt", "1")
        f.writestr("top/d/y.txt", "2")
    assert sorted(archives.unpack(str(z), str(tmp_path / "out"))) == ["d/y.txt", "x.txt"] and (tmp_path / "out" / "d" / "y.txt").read_text() == "2"
    archives.verify(str(z), archives.sha256_of(str(z)) + "  a.zip", z.stat().st_size)
    archives.verify(str(z), None)
    for args in ((str(z), "0" * 64), (str(z), None, 1)):
        with pytest.raises(ValueError):
            archives.verify(*args)
    for name in ("../evil.txt", "/abs.txt", "t/../../e.txt"):
        bad = tmp_path / "bad.zip"
        with zipfile.ZipFile(bad, "w") as f:
            f.writestr("ok.txt", "1")
            f.writestr(name, "2")
        with pytest.raises(ValueError):
            archives.unpack(str(bad), str(tmp_path / "no"))
        assert not (tmp_path / "no").exists()


def test_revisions(tmp_path):
    assert revisions.resolve_ref(str(tmp_path)) == "unknown" and revisions.resolve_ref(str(tmp_path), "x") == "x" and revisions.revision(str(tmp_path)) is None

"""Search as tools of an editor: JSON-RPC over standard input and output, one message a line."""

from __future__ import annotations

import json
import os
import sys
from typing import IO, Any

from pyspark.sql import SparkSession

from ..config import EngineConfig
from ..functions import fixed_values as V
from ..plans import pipeline

PROTOCOL = "2024-11-05"
TOOLS = [
    {
        "name": "search", "description": "Most relevant chunks of the indexed sources, documents and posts, with path, line, score and text.",
        "inputSchema": {
            "type": "object", "required": ["query"],
            "properties": {"query": {"type": "string"}, "k": {"type": "integer", "default": V.TOP_K, "maximum": V.MAX_TOP_K}, "full": {"type": "boolean", "default": False}},
        },
    },
    {
        "name": "digest", "description": "Headings of the digest; with a section, the first one whose heading holds that word.",
        "inputSchema": {"type": "object", "properties": {"section": {"type": "string", "default": ""}}},
    },
]


class Tools:
    def __init__(self, spark: SparkSession, config: EngineConfig):
        self.spark, self.config = spark, config

    def search(self, query: str, k: int = V.TOP_K, full: bool = False) -> str:
        return pipeline.search_text(self.spark, self.config.indexes(), query, int(k), bool(full), profile=self.config.profile)

    def digest(self, section: str = "") -> str:
        if not self.config.digest or not os.path.exists(self.config.digest):
            return f"Digest not found at {self.config.digest!r}."
        return pipeline.digest_text(self.spark, self.config.digest, section)

    def respond(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The answer to a message; None for a notification."""
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        method, given = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}}
        if method == "ping":
            return answer | {"result": {}}
        if method == "tools/list":
            return answer | {"result": {"tools": TOOLS}}
        if method != "tools/call":
            return answer | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}
        if given.get("name") not in {t["name"] for t in TOOLS}:
            return answer | {"error": {"code": -32602, "message": f"unknown tool {given.get('name')!r}"}}
        try:
            text, failed = getattr(self, given["name"])(**(given.get("arguments") or {})), False
        except Exception as e:  # the caller is told, the server goes on
            text, failed = f"{type(e).__name__}: {e}", True
        return answer | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, source: IO[str], out: IO[str]) -> None:
        for line in source:
            if line.strip():
                try:
                    said = self.respond(json.loads(line))
                except ValueError:
                    said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
                if said is not None:
                    print(json.dumps(said, ensure_ascii=False), file=out, flush=True)


def editor_config(config: EngineConfig) -> dict:
    """The entry of an editor's settings that starts these tools, with absolute paths."""
    env = {"LODESTONE_INDEX": config.index_dir}
    if config.extra_dirs:
        env["LODESTONE_EXTRA_INDEXES"] = os.pathsep.join(config.extra_dirs)
    return {"mcpServers": {"lodestone": {"command": os.path.abspath(sys.executable), "args": ["-m", "lodestone", "tools"], "env": env}}}

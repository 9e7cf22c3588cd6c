"""A server of analyses: newline-delimited JSON over TCP, one thread for each connection, all on one session.

A client sends a file's text under a token of its choice and then asks for slices and queries of it; what a token stands for
is kept as stored tables until another text takes its place or the connection ends. Messages: `request-file-analysis`
(filetoken, content, filename, format), `request-slice` (filetoken, criterion, direction), `request-query` (filetoken, query),
`release` (filetoken). Every message has an id, which the answer repeats. What goes wrong is an `error` message; the
connection goes on.
"""

from __future__ import annotations

import json
import socketserver
import threading
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skein import registry
from skein.frontend.program import Program
from skein.operators.queries import QUERIES, run
from skein.storage import discard

VERSION = "1"
FORMATS = {"json": "json", "n-quads": "quads", "compact": "compact", "text": "text"}


class Sessions:
    """The programs of one connection, by token."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.programs: dict[str, Program] = {}

    def put(self, token: str, name: str, content: str) -> Program:
        self.drop(token)
        self.programs[token] = Program(self.spark.createDataFrame([(name, content)], "file_id string, content string"))
        return self.programs[token]

    def get(self, token: str) -> Program:
        if token not in self.programs:
            raise KeyError(f"no file under token {token!r}")
        return self.programs[token]

    def drop(self, token: str) -> None:
        if (old := self.programs.pop(token, None)) is not None:
            discard(old.rows)

    def close(self) -> None:
        for token in list(self.programs):
            self.drop(token)


def _rows(df: DataFrame) -> list[Any]:
    """A result's rows; rows of one file's analysis, so they fit a message."""
    return [json.loads(x) for x in df.toJSON().collect()]


def answer(sessions: Sessions, message: dict[str, Any]) -> dict[str, Any]:
    """The answer to one message."""
    kind, token = message.get("type"), message.get("filetoken", "")
    if kind == "request-file-analysis":
        p = sessions.put(token, message.get("filename", token or "file"), message["content"])
        form = FORMATS[message.get("format", "json")]
        results = {what: _rows(registry.rendered(p, what, form)) for what in ("ast", "dataflow", "cfg") if (what, form) in registry.FORMATS}
        return {"type": "response-file-analysis", "format": message.get("format", "json"), "results": results}
    if kind == "request-slice":
        p = sessions.get(token)
        ids = p.slice(*message["criterion"], forward=message.get("direction") == "forward")
        code = p.code(ids).first()
        return {"type": "response-slice", "ids": sorted(x.id for x in ids.collect()), "code": code.code if code else ""}
    if kind == "request-query":
        requests = message["query"]
        found = run(sessions.get(token), requests)
        names = [r["type"] for r in requests]
        results = [{"error": str(x)} if isinstance(x, Exception) else _rows(x) for x in found]
        return {"type": "response-query", "queries": names, "results": results}
    if kind == "release":
        sessions.drop(token)
        return {"type": "response-release"}
    raise ValueError(f"no message of type {kind!r}")


class _Handler(socketserver.StreamRequestHandler):
    def messages(self) -> Iterator[bytes]:
        while line := self.rfile.readline():
            if line.strip():
                yield line

    def say(self, value: dict[str, Any]) -> None:
        self.wfile.write(json.dumps(value).encode() + b"\n")

    def handle(self) -> None:
        sessions = Sessions(self.server.spark)
        self.say({"type": "hello", "version": VERSION, "queries": sorted(QUERIES)})
        try:
            for line in self.messages():
                given: Any = None
                try:
                    given = json.loads(line)
                    out = answer(sessions, given)
                except Exception as x:  # noqa: BLE001 - one bad message must not end the connection
                    out = {"type": "error", "reason": f"{type(x).__name__}: {x}"}
                self.say(out | ({"id": given["id"]} if isinstance(given, dict) and "id" in given else {}))
        finally:
            sessions.close()


class Server(socketserver.ThreadingTCPServer):
    """Listens until stop(); port 0 takes a free one."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, spark: SparkSession, host: str = "127.0.0.1", port: int = 0):
        super().__init__((host, port), _Handler)
        self.spark = spark

    def start(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.shutdown()
        self.server_close()

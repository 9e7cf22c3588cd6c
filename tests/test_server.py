"""The server: messages over a socket."""

import json
import socket

import pytest

from skein.server import Server


@pytest.fixture
def say(spark):
    server = Server(spark).start()
    with socket.create_connection(server.server_address) as s, s.makefile("rw") as f:
        assert json.loads(f.readline())["type"] == "hello"

        def ask(message):
            f.write((message if isinstance(message, str) else json.dumps(message)) + "\n")
            f.flush()
            return json.loads(f.readline())

        yield ask
    server.stop()


def test_a_session(say):
    code = "x <- 2\ny <- 3\nprint(x)\n"
    got = say({"type": "request-file-analysis", "id": "1", "filetoken": "t", "filename": "a.R", "content": code, "format": "n-quads"})
    assert got["type"] == "response-file-analysis" and got["id"] == "1" and got["results"]["dataflow"]
    got = say({"type": "request-slice", "id": "2", "filetoken": "t", "criterion": ["3@x"]})
    assert got["code"] == "x <- 2\nprint(x)"
    got = say({"type": "request-query", "id": "3", "filetoken": "t", "query": [{"type": "resolve-value", "criteria": ["3@x"]}, {"type": "nothing"}]})
    assert got["results"][0][0]["values"] == ["2"] and "error" in got["results"][1]
    assert say({"type": "release", "filetoken": "t"})["type"] == "response-release"
    assert say({"type": "request-slice", "filetoken": "t", "criterion": ["3@x"]})["type"] == "error"


def test_bad_messages_do_not_end_the_connection(say):
    assert say("no json")["type"] == "error" and say("[1]")["type"] == "error"
    assert say({"type": "what", "id": "9"}) == {"type": "error", "reason": "ValueError: no message of type 'what'", "id": "9"}
    assert say({"type": "request-file-analysis", "content": "x <- 1"})["type"] == "response-file-analysis"

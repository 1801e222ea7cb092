"""The engine over HTTP and as tools on standard input and output, with nothing but Python's own library.

``Service`` gives the answers as plain values; ``respond`` and ``reply`` turn a request's target, or a JSON-RPC
message, to what is sent back; ``serve`` and ``speak`` carry them. Every answer is of as many rows as were asked for, or
of one document of record up to the look-ups' cap, so what comes to the driver is bounded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO
from urllib.parse import parse_qs, unquote, urlsplit

from clauseworks.plans.engine import Engine, NotFound

STORAGE = "CLAUSEWORKS_STORAGE"
PROTOCOL = "2024-11-05"
JSON, TEXT = "application/json", "text/plain; charset=utf-8"


class Invalid(ValueError):
    """A request lacks a parameter, or has one of the wrong kind."""


def storage_of_environment() -> str:
    folder = os.environ.get(STORAGE)
    if not folder:
        raise SystemExit(f"{STORAGE} is not set: give it the path of the store")
    return folder


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def search(self, q: str, limit: int = 10, act: str | None = None, provision_type: str | None = None) -> dict:
        rows = self.engine.search_provisions(q, limit, act, provision_type).orderBy("rank").drop("rank").collect()
        return {"results": [r.asDict() for r in rows]}

    def act(self, act_name: str) -> dict:
        return self.engine.act_metadata(act_name)

    def sections(self, act_name: str) -> dict:
        rows = self.engine.act_provisions(act_name).select("eid", "provision_num", "provision_type", "heading", "text").collect()
        return {"chunks": [r.asDict() for r in rows]}

    def text(self, act_name: str) -> str:
        return self.engine.act_text(act_name)


def _given(values: dict[str, Any], needed: tuple[str, ...], known: dict[str, type]) -> dict[str, Any]:
    """The parameters that are ``known``, as their kinds; others are passed over."""
    out = {}
    for name, kind in known.items():
        value = values.get(name)
        if value is None:
            if name in needed:
                raise Invalid(f"{name} is missing")
            continue
        try:
            out[name] = kind(value)
        except (TypeError, ValueError):
            raise Invalid(f"{name} is no {kind.__name__}") from None
    if out.get("limit", 1) < 1:
        raise Invalid("limit is less than 1")
    return out


SEARCHED = {"q": str, "limit": int, "act": str, "provision_type": str}


# HTTP


def respond(service: Service, target: str) -> tuple[int, str, str]:
    """(status, content type, body) of a GET: /search, /legislation/NAME, /legislation/NAME/sections and .../text."""
    url = urlsplit(target)
    try:
        match [unquote(p) for p in url.path.split("/")]:
            case ["", "search"]:
                values = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                found: dict | str = service.search(**_given(values, ("q",), SEARCHED))
            case ["", "legislation", name]:
                found = service.act(name)
            case ["", "legislation", name, "sections"]:
                found = service.sections(name)
            case ["", "legislation", name, "text"]:
                found = service.text(name)
            case _:
                return 404, JSON, json.dumps({"detail": "Not Found"})
    except NotFound as e:
        return 404, JSON, json.dumps({"detail": f"Act not found: {e}"}, ensure_ascii=False)
    except Invalid as e:
        return 422, JSON, json.dumps({"detail": str(e)})
    return (200, TEXT, found) if isinstance(found, str) else (200, JSON, json.dumps(found, ensure_ascii=False))


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the library's name
            try:
                status, kind, text = respond(service, self.path)
            except Exception as e:  # noqa: BLE001 - one request's failure is not the server's
                self.log_error("%s: %r", self.path, e)
                status, kind, text = 500, JSON, json.dumps({"detail": "Internal Server Error"})
            body = text.encode("utf-8", "replace")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return ThreadingHTTPServer((host, port), Handler)


def serve(service: Service, host: str, port: int) -> None:
    with server(service, host, port) as it:
        it.serve_forever()


# tools: JSON-RPC messages, one a line


def _schema(needed: tuple[str, ...], known: dict[str, type]) -> dict:
    kinds = {str: "string", int: "integer"}
    return {"type": "object", "properties": {k: {"type": kinds[t]} for k, t in known.items()}, "required": list(needed)}


#: Name of a tool: (what it does, parameters that it needs, all that it takes).
TOOLS: dict[str, tuple[str, tuple[str, ...], dict[str, type]]] = {
    "search_legislation": ("Hybrid search over provisions by topic or question, best first.", ("q",), SEARCHED),
    "get_act_metadata": ("Year, date and counts of one Act, by its name.", ("act_name",), {"act_name": str}),
    "get_act_sections": ("Provisions of one Act in reading order. Long for a large Act: search first.", ("act_name",), {"act_name": str}),
    "get_act_text": ("The text of one Act. Very long for a large Act: search first.", ("act_name",), {"act_name": str}),
}


def _call(service: Service, params: dict) -> dict:
    name = params.get("name")
    if name not in TOOLS:
        raise Invalid(f"no tool {name}")
    _, needed, known = TOOLS[name]
    run: Callable[..., dict | str] = {
        "search_legislation": service.search, "get_act_metadata": service.act, "get_act_sections": service.sections, "get_act_text": service.text,
    }[name]
    given = _given(params.get("arguments") or {}, needed, known)
    try:
        found, failed = run(**given), False
    except NotFound as e:
        found, failed = f"Act not found: {e}", True
    text = found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def reply(service: Service, line: str) -> dict | None:
    """The answer to a message; None to a notification."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
    if "id" not in message:
        return None
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    params = message.get("params") or {}
    try:
        match message["method"]:
            case "initialize":
                out["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "clauseworks", "version": "1"}}
            case "ping":
                out["result"] = {}
            case "tools/list":
                out["result"] = {"tools": [{"name": n, "description": d, "inputSchema": _schema(*s)} for n, (d, *s) in TOOLS.items()]}
            case "tools/call":
                out["result"] = _call(service, params)
            case other:
                out["error"] = {"code": -32601, "message": f"no method {other}"}
    except Invalid as e:
        out["error"] = {"code": -32602, "message": str(e)}
    except Exception as e:  # noqa: BLE001 - one call's failure is not the server's
        out["error"] = {"code": -32603, "message": f"{type(e).__name__}: {e}"[:500]}
    return out


def speak(service: Service, read: TextIO, write: TextIO) -> None:
    """Answers messages until the input ends."""
    for line in read:
        if line.strip() and (answer := reply(service, line)) is not None:
            write.write(json.dumps(answer, ensure_ascii=False) + "\n")
            write.flush()

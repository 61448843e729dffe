"""A small HTTP and JSON-RPC front end over a catalog. The work runs as Spark jobs; this only parses and prints.

    python -m trawl.service --cache-dir /data/catalog --root /srv/files --port 8123
"""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
import uuid
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .operators import content
from .operators.catalog import Cancelled, Catalog, derive, session
from .operators.indexes import TrigramIndex
from .sources import storage
from .sources.filesystem import scan
from .sources.store import Store

DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000


class Api:
    """Answers as dictionaries. documents: path_key, content, or a stored content index; None without either.

    rebuild: functions that make a new catalog ("index") and new documents ("content") when asked to.
    """

    def __init__(self, catalog: Catalog | None, documents: DataFrame | content.ContentIndex | None = None, rebuild: dict | None = None):
        self.catalog, self.documents, self.rebuild = catalog, documents, rebuild or {}
        self.config = {"extensions": ["txt", "md"], "maxFileSize": content.MAX_SIZE}

    @staticmethod
    def limit(text: str | None) -> int:
        return min(max(int(text), 1), MAX_LIMIT) if text and text.lstrip("-").isdigit() else DEFAULT_LIMIT

    def search(self, q: str, limit: int, use_index: bool = True, client: str = "") -> dict:
        """A file search; `infile:text` searches the contents. A client's search cancels that client's one before, which answers with nothing; without a client none is."""
        if q.strip().lower().startswith("infile:") and self.documents is not None:
            return self.search_content(q.strip()[7:].strip(), limit)
        began = time.perf_counter()
        try:
            with session(self.catalog.spark, client and "search-" + re.sub("[^A-Za-z0-9_-]", "_", client)):
                rows = self.catalog.search(q, limit, use_index=use_index).collect()  # limit rows at most
        except Cancelled:
            rows = []
        found = [{"name": r["name"], "path": r["path"], "type": r["type"], "size": r["size"], "modTime": r["mod_time"]} for r in rows]
        return {"results": found, "count": len(found), "queryTimeMs": round((time.perf_counter() - began) * 1000, 2)}

    def search_content(self, q: str, limit: int) -> dict:
        search = self.documents.search if isinstance(self.documents, content.ContentIndex) else partial(content.search, self.documents)
        rows = content.described(search(q, limit), self.catalog.files).orderBy("file_path").collect()
        found = [{"fileName": r["file_name"], "filePath": r["file_path"], "snippet": r["snippet"], "matchOffset": r["match_offset"]} for r in rows]
        return {"results": found, "count": len(found)}

    def recent(self, n: int) -> dict:
        rows = self.catalog.recent(n).collect()
        return {"results": [{"name": r["name"], "path": r["path"], "type": r["type"], "size": r["size"], "modTime": r["mod_time"]} for r in rows]}

    def status(self) -> dict:
        row = self.catalog.status().first()
        # With deltas a store holds more records than live ones, until it is compacted.
        return {"totalRecordCount": max(self.catalog.total, row["live_records"]), "liveRecordCount": row["live_records"], "files": row["files"], "folders": row["folders"], "contentIndexedFileCount": self.indexed_files()}

    def indexed_files(self) -> int:
        if self.documents is None:
            return 0
        return (self.documents.documents if isinstance(self.documents, content.ContentIndex) else self.documents).count()

    def read_contents(self, paths: DataFrame) -> DataFrame:
        """Contents of catalog rows, by the present settings: files of the extensions, texts of maxFileSize bytes at most."""
        return content.read_files(content.eligible(paths, set(self.config["extensions"])), self.config["maxFileSize"])

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
        if method not in ("GET", "POST"):
            return 405, {"error": "Method not allowed"}
        return self.get(target) if method == "GET" else self.post(target, body)

    def get(self, target: str) -> tuple[int, dict]:
        url = urlsplit(target)
        args = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        if url.path == "/api/health":
            return 200, {"status": "ok"}
        if url.path == "/api/content/config":
            return 200, self.config
        if url.path not in ("/api/search", "/api/search/content", "/api/recent", "/api/status"):
            return 404, {"error": "not found"}
        if self.catalog is None or (url.path == "/api/search/content" and self.documents is None):
            return 503, {"error": "index not ready"}
        if url.path == "/api/status":
            return 200, self.status()
        if url.path == "/api/recent":
            return 200, self.recent(self.limit(args.get("limit")))
        if not args.get("q"):
            return 400, {"error": "missing parameter q"}
        if url.path == "/api/search/content":
            return 200, self.search_content(args["q"], self.limit(args.get("limit")))
        return 200, self.search(args["q"], self.limit(args.get("limit")), args.get("trigram") != "0", args.get("session", ""))

    def post(self, target: str, body: bytes) -> tuple[int, dict]:
        path = urlsplit(target).path
        if path == "/api/index/rebuild" and "index" in self.rebuild:
            self.catalog = self.rebuild["index"]()
            return 200, {"status": "rebuilt"}
        if path == "/api/content/rebuild" and "content" in self.rebuild:
            self.documents = self.rebuild["content"]()
            return 200, {"status": "rebuilt"}
        if path != "/api/content/config":
            return 404, {"error": "not found"}
        try:
            given = json.loads(body or b"{}")
        except ValueError:
            return 400, {"error": "body is not JSON"}
        if not isinstance(given, dict) or not isinstance(given.get("extensions", []), list) or not isinstance(given.get("maxFileSize", 0), int):
            return 400, {"error": "extensions must be a list and maxFileSize a number"}
        self.config |= {k: given[k] for k in self.config if k in given}
        return 200, self.config


TOOLS = {
    "search_files": ({"query": "string", "limit": "integer"}, lambda api, a: api.search(a["query"], api.limit(str(a.get("limit", ""))))),
    "search_content": ({"keyword": "string", "limit": "integer"}, lambda api, a: api.search_content(a["keyword"], api.limit(str(a.get("limit", ""))))),
    "recent_files": ({"limit": "integer"}, lambda api, a: api.recent(api.limit(str(a.get("limit", ""))))),
    "index_status": ({}, lambda api, a: api.status()),
}


def rpc(api: Api, request: dict) -> dict | None:
    """Answer to one JSON-RPC request; a notification has none."""
    if "id" not in request:
        return None
    answer = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "trawl", "version": "0.1"}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        shape = lambda fields: {"type": "object", "properties": {k: {"type": v} for k, v in fields.items()}}
        return answer | {"result": {"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": shape(f)} for n, (f, _) in TOOLS.items()]}}
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            return answer | {"error": {"code": -32602, "message": "unknown tool"}}
        try:
            text = json.dumps(TOOLS[params["name"]][1](api, params.get("arguments") or {}), ensure_ascii=False)
        except KeyError as e:
            return answer | {"error": {"code": -32602, "message": f"missing argument {e}"}}
        return answer | {"result": {"content": [{"type": "text", "text": text}]}}
    return answer | {"error": {"code": -32601, "message": "unknown method"}}


def serve_rpc(api: Api, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            try:
                answer = rpc(api, json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)


def server(api: Api, port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, answer: dict) -> None:
            data = json.dumps(answer, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _any(self):
            self._send(*api.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = _any  # noqa: N815

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def scanned(spark: SparkSession, root: str, hidden: bool, work: str) -> DataFrame:
    """The files below root as a catalog; root must be readable by all executors. Levels of the scan are kept in work."""
    done = scan(spark, root, work, skip_hidden=not hidden, report=lambda p: print(f"level {p.level}: {p.records} records, {p.errors} errors, {p.waiting} directories to go", file=sys.stderr))
    return derive(done.records)


def indexed(spark: SparkSession, cache: str, files: DataFrame, contents: DataFrame | None = None) -> Store:
    """A store at cache with the catalog, the index of its names and, if given, contents with theirs."""
    store = Store(spark, cache)
    staged = store.stage(files.sortWithinPartitions("path"), storage.FILES)
    tables = {storage.FILES: (staged, storage.KEY)} | TrigramIndex.built(store, "names", staged.df, "match_path", table=storage.FILES)
    store.replace(tables | (content.ContentIndex.built(store, contents) if contents is not None else {}))
    return store


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--cache-dir", "--snapshots", dest="cache", required=True, help="folder of the store")
    p.add_argument("--root", help="scan this directory into the store first")
    p.add_argument("--show-hidden", action="store_true", help="scan hidden files too")
    p.add_argument("--documents", help="contents as Parquet: path_key, content")
    p.add_argument("--port", type=int, default=8123)
    p.add_argument("--rpc", action="store_true", help="JSON-RPC on standard input instead of HTTP")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("trawl").getOrCreate()
    api = Api(None)

    def rebuild(contents: bool = True) -> Catalog:
        store = Store(spark, a.cache)
        if a.root:
            files = scanned(spark, a.root, a.show_hidden, f"{a.cache}/_scans/{uuid.uuid4().hex}").persist()
            store = indexed(spark, a.cache, files, api.read_contents(files))
            files.unpersist()
        if f"{content.ContentIndex.TABLE}" in store.head().tables:
            api.documents = content.ContentIndex(store)
        return Catalog.stored(store)

    def again() -> DataFrame | content.ContentIndex:
        if a.documents:
            return spark.read.parquet(a.documents)
        api.catalog = rebuild()
        return api.documents

    api.rebuild = {"index": rebuild, "content": again}
    api.catalog = rebuild()
    if a.documents:
        api.documents = again()
    serve_rpc(api) if a.rpc else server(api, a.port).serve_forever()


if __name__ == "__main__":
    main()

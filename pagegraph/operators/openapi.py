"""Endpoints of API documents (versions 2 and 3, JSON or YAML), flattened in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places where API documents are looked for, in this order, and verbs in the order of their endpoints.
PLACES = [
    "/openapi.json", "/openapi.yaml", "/openapi.yml", "/swagger.json", "/swagger.yaml", "/swagger.yml", "/v2/api-docs", "/v3/api-docs", "/api-docs", "/api/openapi.json",
    "/api/swagger.json", "/api/v1/openapi.json", "/v1/openapi.json", "/v1/swagger.json", "/swagger/v1/swagger.json", "/docs/openapi.json", "/spec/openapi.json", "/swagger-ui.html", "/redoc",
]
VERBS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
#: Endpoints after which a batch goes on.
FULL = 2000
#: Characters that PyYAML's two loaders don't read alike everywhere: tabs, other line ends and marks, and ! % ? @ `.
UNLIKE = re.compile("[^\n\\x20\"-$&->A-_a-~\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]")
#: Levels of nesting that libyaml is given.
DEEP = 100
SCHEMA = "source_url string, ord int, url string, method string, path_params array<string>, query_params array<string>, body_params array<string>, raw_path string"


def yaml_tree(body: str) -> object:
    """What yaml.safe_load gives, by libyaml where both read alike; what that refuses, and deep nesting, is left to the other."""
    import yaml

    if not hasattr(yaml, "CSafeLoader") or UNLIKE.search(body):
        return yaml.safe_load(body)
    loader, depth = yaml.CSafeLoader(body), 0

    def down(*_: object) -> None:
        nonlocal depth
        depth += 1
        if depth > DEEP:
            raise yaml.YAMLError("libyaml's composer has no limit of its own")

    def up() -> None:
        nonlocal depth
        depth -= 1

    loader.descend_resolver, loader.ascend_resolver = down, up
    try:
        return loader.get_single_data()
    except Exception:
        return yaml.safe_load(body)
    finally:
        loader.dispose()


def loaded(body: str) -> dict | None:
    """The document's tree with text keys; null if it is neither JSON nor YAML, or no API document.

    It is one of version 2 if swagger is a text that is not empty, else of version 3 if openapi is a text that starts
    with 3. or there are paths. A YAML number such as an unquoted 2.0 is no text.
    """
    try:
        tree = json.loads(body)
    except ValueError:
        try:
            tree = yaml_tree(body)
        except Exception:
            return None
    if not isinstance(tree, dict):
        return None
    tree = json.loads(json.dumps(tree, default=str))
    return tree if is_second(tree) or str_of(tree, "openapi").startswith("3.") or tree.get("paths") is not None else None


def str_of(tree: dict, name: str) -> str:
    value = tree.get(name)
    return value if isinstance(value, str) else ""


def is_second(tree: dict) -> bool:
    return str_of(tree, "swagger") != ""


def pointed(tree: dict, node: object) -> dict:
    """The object a local $ref names, one hop; the node itself where that fails."""
    if not isinstance(node, dict):
        return {}
    ref = node.get("$ref")
    if not isinstance(ref, str) or not ref.startswith("#/"):
        return node
    at: object = tree
    for part in ref[2:].split("/"):
        at = at.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
    return at if isinstance(at, dict) else node


def endpoints(source: str, tree: dict) -> list[tuple]:
    """Rows of endpoints: paths in order, verbs in VERBS' order; parameters of the operation replace those of the path."""
    parts = urlsplit(source)
    origin = f"{parts.scheme}://{parts.netloc}"
    if is_second(tree):
        base = tree.get("basePath") or ""
    else:
        servers = tree.get("servers") or [{}]
        base = urlsplit(str(pointed(tree, servers[0]).get("url", ""))).path
    base = base.rstrip("/")
    rows = []
    for path, item in sorted((tree.get("paths") or {}).items()):
        item = pointed(tree, item)
        for verb in VERBS:
            if not isinstance(item.get(verb), dict):
                continue
            merged: dict[tuple[str, str], dict] = {}
            for p in [*(item.get("parameters") or []), *(item[verb].get("parameters") or [])]:
                p = pointed(tree, p)
                merged[str(p.get("name")), str(p.get("in"))] = p
            named = lambda place: [n for n, where in merged if where == place]  # noqa: B023, E731
            body = named("formData")
            schemas = [pointed(tree, p.get("schema")) for (_, where), p in merged.items() if where == "body"]
            content = pointed(tree, item[verb].get("requestBody")).get("content") or {}
            if content:
                kind = "application/json" if "application/json" in content else min(content)
                schemas.append(pointed(tree, content[kind].get("schema")))
            for s in schemas:
                body += sorted(s.get("properties") or {})
            rows.append((source, len(rows), origin + base + path, verb.upper(), named("path"), named("query"), body, path))
    return rows


def flattened(documents: DataFrame) -> DataFrame:
    """(source_url, ord, url, method, path_params, query_params, body_params, raw_path) of (source_url, body); what can't be loaded has no rows."""
    texts = pa.list_(pa.string())
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), texts, texts, texts, pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = loaded(body or "")
                rows += endpoints(source or "", tree) if tree else []
                if len(rows) >= FULL:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return documents.select(F.col("source_url").cast("string"), F.col("body").cast("string")).mapInArrow(run, SCHEMA)

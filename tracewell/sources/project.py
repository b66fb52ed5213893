"""Readers of a project's artifacts: manifest, catalog, compiled SQL files and seed headers.

These are small metadata files, read on the driver where the order of JSON keys is kept, and turned
into tables. Paths that a manifest names stay inside the folder they belong to: no absolute parts, no
`..`, links resolved, regular files only.
"""

from __future__ import annotations

import csv
import io
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.resolve import relation_key

KINDS = ("model", "source", "seed", "snapshot")
HEADER_BYTES = 1 << 20

NODES = (
    "uid string, name string, kind string, package string, file string, relation string, materialized string, "
    "sql string, sql_source string, sql_problem string, declared array<string>, parents array<string>, file_columns array<string>, "
    "model_ord int, level int, reads_of array<string>"
)
LISTS = "uid string, source string, columns array<string>"


class ProjectError(ValueError):
    """An artifact that can't be read; the message names its path."""


@dataclass
class Node:
    uid: str
    name: str
    kind: str
    package: str = ""
    file: str = ""
    relation: str = ""
    materialized: str = ""
    language: str = "sql"
    sql: str | None = None
    sql_source: str = "missing"  # manifest, file, unusable, missing
    sql_problem: str = ""
    declared: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    root_path: str = ""
    delimiter: str = ","
    file_columns: list[str] = field(default_factory=list)


@dataclass
class Project:
    nodes: dict[str, Node]
    name: str = ""
    adapter: str = ""
    version: str = ""
    warehouse: dict[str, list[str]] = field(default_factory=dict)
    elsewhere: list[tuple[str, str, str]] = field(default_factory=list)  # (uid, its relation, the catalog's other one)


def distinct(names) -> list[str]:
    return list(dict.fromkeys(n.lower() for n in names))


def _json(path: str | os.PathLike) -> dict:
    try:
        with open(path, encoding="utf-8-sig") as f:
            out = json.load(f)
    except (OSError, ValueError) as e:
        raise ProjectError(f"{path}: {e}") from e
    if not isinstance(out, dict):
        raise ProjectError(f"{path}: no object")
    return out


def from_manifest(raw: dict) -> Project:
    """The models, sources, seeds and snapshots of a manifest, with parents in its order."""
    meta, parent_map = raw.get("metadata") or {}, raw.get("parent_map") or {}
    nodes = {}
    for uid, n in sorted({**(raw.get("nodes") or {}), **(raw.get("sources") or {})}.items()):
        if n.get("resource_type") not in KINDS:
            continue
        config = n.get("config") or {}
        parents = parent_map.get(uid) if uid in parent_map else (n.get("depends_on") or {}).get("nodes") or []
        delimiter = config.get("delimiter")
        node = Node(uid, n.get("name") or "", n["resource_type"], n.get("package_name") or "", n.get("original_file_path") or "", n.get("relation_name") or "", config.get("materialized") or "", n.get("language") or "sql")
        node.declared = distinct(c.get("name") or key for key, c in (n.get("columns") or {}).items())
        node.parents, node.root_path = list(dict.fromkeys(parents or [])), n.get("root_path") or ""
        node.delimiter = delimiter if isinstance(delimiter, str) and len(delimiter) == 1 else ","
        if n.get("compiled_code") is not None:
            node.sql, node.sql_source = n["compiled_code"], "manifest"
        nodes[uid] = node
    return Project(nodes, meta.get("project_name") or "", meta.get("adapter_type") or "", meta.get("dbt_version") or "")


def add_catalog(project: Project, raw: dict) -> None:
    """Column lists of the warehouse, in its order; an entry counts only if it is of the manifest's relation."""
    for uid, entry in {**(raw.get("nodes") or {}), **(raw.get("sources") or {})}.items():
        node = project.nodes.get(uid)
        if node is None:
            continue
        meta = entry.get("metadata") or {}
        where = relation_key(".".join(p for p in (meta.get("database"), meta.get("schema"), meta.get("name")) if p))
        ours = relation_key(node.relation) if node.relation else ""
        n = min(len(where.split(".")), len(ours.split("."))) if ours else 0
        if n and where.split(".")[-n:] != ours.split(".")[-n:]:
            project.elsewhere.append((uid, ours, where))
            continue
        columns = [(c.get("index") is None, c.get("index") or 0, i, c.get("name") or key) for i, (key, c) in enumerate((entry.get("columns") or {}).items())]
        names = distinct(name for *_, name in sorted(columns))
        known = set(names)
        project.warehouse[uid] = [n for n in names if "." not in n or n.rsplit(".", 1)[0] not in known and n.split(".")[0] not in known]


def _inside(folder: str, parts: list[str]) -> str | None:
    """A regular file under `folder`, or None; parts must be plain and links must stay inside."""
    if any(p in ("", ".", "..") or os.path.isabs(p) or "\\" in p or ":" in p or "\0" in p for p in parts):
        return None
    held = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(held, *parts))
    return path if path.startswith(held + os.sep) and os.path.isfile(path) else None


def _plain(path: str) -> list[str]:
    return path.replace("\\", "/").split("/")


def check_compiled(folder: str, project: Project) -> None:
    if not os.path.isdir(folder):
        raise ProjectError(f"{folder}: no folder")
    if not any(os.path.isdir(os.path.join(folder, p)) for p in {n.package for n in project.nodes.values()} if p):
        raise ProjectError(f"{folder}: holds no folder of a package of the manifest")


def add_compiled(project: Project, folder: str) -> None:
    """SQL from `<folder>/<package>/<file>` for models whose manifest has none; a package's files may also lie in its own subfolder."""
    check_compiled(folder, project)
    for node in project.nodes.values():
        if node.kind not in ("model", "snapshot") or node.sql_source == "manifest" or node.language != "sql" or not node.file:
            continue
        tries = [[node.package, *_plain(node.file)]]
        if node.package != project.name:
            tries.append([node.package, "dbt_packages", node.package, *_plain(node.file)])
        for parts in tries:
            if path := _inside(folder, parts):
                try:
                    node.sql, node.sql_source = Path(path).read_text(encoding="utf-8"), "file"
                except (OSError, UnicodeDecodeError) as e:
                    node.sql_source, node.sql_problem = "unusable", str(e)
                break


def seed_header(data: bytes, delimiter: str = ",", whole: bool = True) -> list[str] | None:
    """Names in the first record of a CSV file; None if they can't be column names or the record isn't whole."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        if whole or e.start < len(data) - 3:
            return None
        text = data[: e.start].decode("utf-8-sig")
    quoted, end = False, None
    for i, c in enumerate(text):
        quoted ^= c == '"'
        if c in "\r\n" and not quoted:
            end = i
            break
    if end is None and (not whole or quoted):
        return None
    record = text if end is None else text[:end]
    if not record.strip():
        return None
    names = next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter))
    bad = any(not n or n != n.strip() or "\n" in n or "\r" in n for n in names) or len({n.lower() for n in names}) < len(names)
    return None if bad else [n.lower() for n in names]


def add_seeds(project: Project, folder: str) -> None:
    """Headers of seed files, for seeds that the catalog doesn't list."""
    for node in project.nodes.values():
        if node.kind != "seed" or node.uid in project.warehouse or not node.file:
            continue
        parts = _plain(node.file)
        roots = [(folder, parts), (folder, ["dbt_packages", node.package, *parts])]
        if node.root_path:
            roots.append((node.root_path, parts))
        for root, tail in roots:
            if path := _inside(root, tail):
                with open(path, "rb") as f:
                    data = f.read(HEADER_BYTES + 1)
                node.file_columns = seed_header(data[:HEADER_BYTES], node.delimiter, len(data) <= HEADER_BYTES) or []
                break


def load(manifest: str, catalog: str | None = None, compiled: str | None = None, seeds: str | None = None) -> Project:
    project = from_manifest(_json(manifest))
    if compiled:
        add_compiled(project, compiled)
    if catalog:
        add_catalog(project, _json(catalog))
    if seeds:
        add_seeds(project, seeds)
    return project


def model_order(project: Project) -> list[str]:
    """Models and snapshots, parents first: depth first from the sorted ids, a node's last parent before its others; circles are cut."""
    models = {u for u, n in project.nodes.items() if n.kind in ("model", "snapshot")}
    order, state = [], {}
    for root in sorted(models):
        stack = [(root, False)]
        while stack:
            uid, done = stack.pop()
            if done:
                order.append(uid)
            elif uid not in state:
                state[uid] = True
                stack.append((uid, True))
                stack += [(p, False) for p in project.nodes[uid].parents if p in models and p not in state]
    return order


def levels(project: Project, order: list[str]) -> dict[str, int]:
    """The longest way down to each model from a node without parents, in the order given; edges of circles that point back don't count."""
    out: dict[str, int] = {}
    for uid in order:
        out[uid] = max((out.get(p, 0) + 1 for p in project.nodes[uid].parents if p in project.nodes), default=0)
    return out


def read_nodes(project: Project, uid: str) -> list[str]:
    """A model's parents that have a relation; an ephemeral one is replaced, in place, by what it reads."""
    out, seen, stack = [], set(), list(reversed(project.nodes[uid].parents))
    while stack:
        parent = stack.pop()
        node = project.nodes.get(parent)
        if node is None or parent in seen:
            continue
        seen.add(parent)
        if node.kind in ("model", "snapshot") and node.materialized == "ephemeral":
            stack += reversed(node.parents)
        elif node.relation:
            out.append(parent)
    return out


def tables(spark: SparkSession, project: Project) -> tuple[DataFrame, DataFrame]:
    """(nodes, column lists of warehouse, seed_file and declared) of a project."""
    order = model_order(project)
    place, level = {u: i for i, u in enumerate(order)}, levels(project, order)
    rows = [
        (n.uid, n.name, n.kind, n.package, n.file, n.relation or None, n.materialized, n.sql, n.sql_source, n.sql_problem, n.declared, n.parents, n.file_columns, place.get(n.uid), level.get(n.uid), read_nodes(project, n.uid))
        for n in project.nodes.values()
    ]
    lists = [(u, "warehouse", c) for u, c in project.warehouse.items() if c]
    lists += [(n.uid, "seed_file", n.file_columns) for n in project.nodes.values() if n.file_columns]
    lists += [(n.uid, "declared", n.declared) for n in project.nodes.values() if n.declared]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame(lists, LISTS)

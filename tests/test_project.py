import json
import os

import pytest

from tracewell import cli
from tracewell.sources.demo import harbour
from tracewell.sources.project import ProjectError, add_catalog, from_manifest, levels, load, model_order, read_nodes, seed_header
from tracewell.sources.sinks import replace


def manifest(**more):
    nodes = {
        "model.p.b": {"name": "b", "resource_type": "model", "package_name": "p", "original_file_path": "models/b.sql", "relation_name": "db.s.b", "config": {"materialized": "view"}, "depends_on": {"nodes": ["model.p.e"]}, "columns": {"ID": {"name": "ID"}}},
        "model.p.e": {"name": "e", "resource_type": "model", "package_name": "p", "original_file_path": "models/e.sql", "relation_name": None, "config": {"materialized": "ephemeral"}, "depends_on": {"nodes": ["source.p.raw"]}, "compiled_code": "select 1"},
        "test.p.t": {"name": "t", "resource_type": "test"},
    }
    sources = {"source.p.raw": {"name": "raw", "resource_type": "source", "relation_name": '"db"."s"."raw"'}}
    return {"metadata": {"project_name": "p"}, "nodes": nodes, "sources": sources, **more}


def test_manifest_kinds_parents_and_ephemerals():
    project = from_manifest(manifest())
    assert set(project.nodes) == {"model.p.b", "model.p.e", "source.p.raw"}
    assert project.nodes["model.p.b"].declared == ["id"]
    assert read_nodes(project, "model.p.b") == ["source.p.raw"]
    order = model_order(project)
    assert order == ["model.p.e", "model.p.b"] and levels(project, order) == {"model.p.e": 1, "model.p.b": 2}


def test_circles_end():
    raw = manifest()
    raw["nodes"]["model.p.e"]["depends_on"]["nodes"] = ["model.p.b"]
    assert sorted(model_order(from_manifest(raw))) == ["model.p.b", "model.p.e"]


def test_last_parent_is_walked_first():
    assert [u.split(".")[-1] for u in model_order(harbour())] == ["moorings", "berth_days", "fleet", "tide_at_arrival", "vessel_summary"]


def test_catalog_counts_only_for_the_same_relation():
    project = from_manifest(manifest())
    entry = lambda db, name: {"metadata": {"database": db, "schema": "s", "name": name}, "columns": {"B": {"name": "B", "index": 2}, "a": {"name": "A", "index": 1}, "a.x": {"name": "a.x", "index": 3}}}
    add_catalog(project, {"nodes": {"model.p.b": entry("db", "b")}, "sources": {"source.p.raw": entry("other", "raw")}})
    assert project.warehouse == {"model.p.b": ["a", "b"]}
    assert project.elsewhere == [("source.p.raw", "DB.S.RAW", "OTHER.S.RAW")]


@pytest.mark.parametrize(
    ("data", "found"),
    [
        (b"\xef\xbb\xbfID,Name\n1,x", ["id", "name"]),
        (b'"a,b",c\r\n', ["a,b", "c"]),
        (b"a,a\n", None),
        (b"a, b\n", None),
        (b"a,\n", None),
        (b"", None),
        (b'"a\nb",c\n', None),
        (b"only", ["only"]),
    ],
)
def test_seed_headers(data, found):
    assert seed_header(data) == found


def test_compiled_files_stay_inside(tmp_path):
    (tmp_path / "c/p/models").mkdir(parents=True)
    (tmp_path / "secret.sql").write_text("select 2")
    os.symlink(tmp_path / "secret.sql", tmp_path / "c/p/models/b.sql")
    raw = tmp_path / "manifest.json"
    raw.write_text(json.dumps(manifest()))
    assert load(str(raw), compiled=str(tmp_path / "c")).nodes["model.p.b"].sql is None
    (tmp_path / "c/p/models/b.sql").unlink()
    (tmp_path / "c/p/models/b.sql").write_text("select 3")
    assert load(str(raw), compiled=str(tmp_path / "c")).nodes["model.p.b"].sql == "select 3"
    with pytest.raises(ProjectError):
        load(str(raw), compiled=str(tmp_path / "none"))


def test_writes_replace_links(tmp_path):
    (tmp_path / "target").write_text("kept")
    os.symlink(tmp_path / "target", tmp_path / "link")
    replace(str(tmp_path / "link"), "new")
    assert (tmp_path / "target").read_text() == "kept" and (tmp_path / "link").read_text() == "new"
    assert not os.path.islink(tmp_path / "link")


def test_command_line_errors(tmp_path, capsys):
    assert cli.main(["what"]) == 2
    assert cli.main(["generate", "--project", str(tmp_path)]) == 1
    assert "manifest.json" in capsys.readouterr().err

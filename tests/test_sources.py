"""Source trees and snapshots: folders that are never listed, depth, and versions that read only what changed."""

from __future__ import annotations

import hashlib
import os

import pytest

from ledgerwing.plans import source_queries
from ledgerwing.sources import readers
from ledgerwing.sources.snapshots import SnapshotStore


def put(root, name: str, text: str, at: int = 1_700_000_000) -> None:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_a_tree_without_skipped_folders_tests_and_depths(spark, tmp_path):
    deep = "/".join("abcdefghi")
    for name in ("a.py", "src/b.py", "src/c.txt", "src/test_d.py", "tests/e.py", ".git/f.py", "src/node_modules/g.py", ".hidden/h.py", "build/i.py", f"{deep}/j.py", f"{deep[:15]}/k.py"):
        put(tmp_path, name, "x")
    sealed = tmp_path / "src" / "venv"
    sealed.mkdir()
    found = sorted(r["path"] for r in readers.read_source_tree(spark, str(tmp_path)).collect())
    assert found == ["a.py", "a/b/c/d/e/f/g/h/k.py", "src/b.py"]
    assert [r["path"] for r in readers.read_source_tree(spark, str(tmp_path), ("txt",), max_depth=1).collect()] == ["src/c.txt"]
    folders = readers.kept_folders(spark, str(tmp_path), max_depth=1)
    assert sorted(os.path.relpath(f.removeprefix("file:"), tmp_path) for f in folders) == [".", "a", "src", "tests"]


def test_versions_read_only_what_changed(spark, tmp_path):
    root, store = tmp_path / "tree", SnapshotStore(spark, str(tmp_path / "store"))
    for name in ("a.py", "b/c.md", "b/d.py", "node_modules/e.py", ".f"):
        put(root, name, "one")
    assert store.versions() == [] and store.take(str(root)) == 1
    first = {r["path"]: r for r in store.load(1).collect()}
    assert set(first) == {"a.py", "b/c.md", "b/d.py"} and all(r["hashed"] for r in first.values())
    assert first["a.py"]["content_hash"] == hashlib.sha256(b"one").hexdigest()

    put(root, "a.py", "two")  # as long and as old as before: not read again
    put(root, "b/d.py", "three", at=1_700_000_100)
    put(root, "g.py", "new")
    (root / "b" / "c.md").unlink()
    assert store.take(str(root)) == 2 and store.versions() == [1, 2]
    second = {r["path"]: r for r in store.load(2).collect()}
    assert {p: r["hashed"] for p, r in second.items()} == {"a.py": False, "b/d.py": True, "g.py": True}
    assert second["a.py"]["content_hash"] == first["a.py"]["content_hash"]
    assert second["b/d.py"]["content_hash"] == hashlib.sha256(b"three").hexdigest()
    assert sorted((r["path"], r["change"]) for r in store.diff(1, 2).collect()) == [("b/c.md", "removed"), ("b/d.py", "modified"), ("g.py", "added")]
    assert store.take(str(root), (".md",)) == 3 and store.load(3).count() == 0


@pytest.mark.parametrize("at_once", [1, 2])
def test_many_changed_files_take_several_reads(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr("ledgerwing.sources.snapshots.READ_AT_ONCE", at_once)
    root, store = tmp_path / "tree", SnapshotStore(spark, str(tmp_path / "store"))
    put(root, "a", "0")
    store.take(str(root))
    for n in range(5):
        put(root, f"f{n}", str(n))
    found = {r["path"]: r["content_hash"] for r in store.load(store.take(str(root))).collect()}
    assert found == {"a": hashlib.sha256(b"0").hexdigest()} | {f"f{n}": hashlib.sha256(str(n).encode()).hexdigest() for n in range(5)}


def test_a_half_written_version_does_not_count(spark, tmp_path):
    root, store = tmp_path / "tree", SnapshotStore(spark, str(tmp_path / "store"))
    put(root, "a", "0")
    store.take(str(root))
    (tmp_path / "store" / "v7").mkdir()
    assert store.versions() == [1]


def test_documents_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "FILES_A_TASK", 2)
    rows = spark.range(5).coalesce(1).selectExpr("'s' || id as id", "'t' as title")
    folder = source_queries._documents(rows, str(tmp_path / "documents"))
    files = [f for f in os.listdir(folder) if f.endswith(".json")]
    assert len(files) == 5 and len({f.split("-")[1] for f in files}) > 1
    assert sorted(r["id"] for r in readers.read_decisions(spark, folder).collect()) == ["s0", "s1", "s2", "s3", "s4"]
    assert source_queries._documents(rows.limit(0), str(tmp_path / "none"))

"""Folders kept alike."""

import pytest

from parlance.sources import sync


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_folders_are_made_alike(spark, tmp_path):
    a, b = tmp_path / "a b", tmp_path / "é"  # names that a URI must quote
    for name, data in {"one.wav": b"1" * 100, "deep/er/two.wav": b"2", "deep/same.wav": b"same", "empty.wav": b"", "100% ü.wav": b"x", "note.txt": b"n"}.items():
        (a / name).parent.mkdir(parents=True, exist_ok=True)
        (a / name).write_bytes(data)
    (b / "deep").mkdir(parents=True)
    (b / "deep/same.wav").write_bytes(b"same")
    (b / "one.wav").write_bytes(b"0" * 100)  # of the same size
    (b / "old.wav").write_bytes(b"old")
    kept = (b / "deep/same.wav").stat().st_ino
    run = lambda n, **how: {r.name: (r.action, r.error) for r in sync.synced(spark, str(a), str(b), report=str(tmp_path / f"r{n}"), **how).collect()}
    copy, keep = ("copy", None), ("keep", None)
    assert run(1, glob="*.wav") == {"one.wav": copy, "deep/er/two.wav": copy, "deep/same.wav": keep, "empty.wav": copy, "100% ü.wav": copy, "old.wav": ("extra", None)}
    assert (b / "deep/same.wav").stat().st_ino == kept and tree(b) == {**{n: d for n, d in tree(a).items() if n != "note.txt"}, "old.wav": b"old"}
    again = run(2)
    assert again.pop("note.txt") == copy and again.pop("old.wav") == ("extra", None) and set(again.values()) == {keep}
    assert run(3, delete=True)["old.wav"] == ("delete", None) and tree(a) == tree(b)
    assert set(run(4, digest=False).values()) == {keep} and not list(b.rglob("*.part"))


def test_a_file_that_fails_is_a_row(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (a / "x").write_bytes(b"new")
    (a / "y").write_bytes(b"new")
    (b / "x" / "in the way").mkdir(parents=True)
    got = {r.name: r.error for r in sync.synced(spark, str(a), str(b), report=str(tmp_path / "r")).collect()}
    assert got["y"] is None and got["x"] and not [p for p in b.rglob("*") if p.name.endswith(".part")]


def test_odd_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert sync.synced(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
    with pytest.raises(FileNotFoundError):
        sync.synced(spark, str(tmp_path / "none"), str(tmp_path / "b"))
    for x, y in (("a", "a"), ("a", "a/b"), ("a/b", "a")):
        with pytest.raises(ValueError):
            sync.synced(spark, str(tmp_path / x), str(tmp_path / y))

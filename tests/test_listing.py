"""Directory walks."""

import os

from jobtrail.sources.files import walk_files


def test_walk_finds_everything(spark, tmp_path):
    """Deep and empty directories, empty and hidden files, odd names; several tasks for one level."""
    sizes = {"a.log": 3, "empty": 0, "d/b c.log": 5, "d/e/f/g/deep.txt": 1, "d/_hidden": 2, "d/e/.dot": 4, "é/ü+%.log": 6}
    for name, size in sizes.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    os.makedirs(tmp_path / "nothing" / "inside")
    rows = walk_files(spark, str(tmp_path), tasks=3).collect()
    assert len(rows) == len({r["path"] for r in rows})
    assert {r["path"]: r["size_bytes"] for r in rows if not r["is_dir"]} == sizes
    assert {r["path"] for r in rows if r["is_dir"]} == {"d", "d/e", "d/e/f", "d/e/f/g", "é", "nothing", "nothing/inside"}
    assert all(r["mtime"] is not None for r in rows)


def test_walk_of_nothing(spark, tmp_path):
    assert walk_files(spark, str(tmp_path)).count() == 0
    assert walk_files(spark, str(tmp_path / "missing")).count() == 0

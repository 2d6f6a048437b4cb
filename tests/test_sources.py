"""Rows that a source must not lose."""

from tagloom.sources import catalogue


def test_malformed_lines_are_failed_rows(spark, tmp_path):
    good = '{"relative_path": "a/01.flac", "full_path": "/l/a/01.flac", "raw_tags": {"TITLE": ["x"]}}'
    (tmp_path / "rows.json").write_text(f'{good}\n{{"relative_path": "a/02.fl\nnot json\n')
    rows, failed = catalogue.scan(catalogue.read_raw_json(spark, str(tmp_path / "rows.json")))
    assert [r["relative_path"] for r in rows.collect()] == ["a/01.flac"]
    messages = sorted(r["message"] for r in failed.collect())
    assert len(messages) == 2 and messages[0].startswith("malformed row: ") and "not json" in messages[0] + messages[1]


def test_listing_cuts_the_root_by_its_length(spark, tmp_path):
    root = tmp_path / "lib"
    inner = root / "x" / str(root).lstrip("/")
    inner.mkdir(parents=True)
    (inner / "9.flac").write_bytes(b"audio")
    (root / "1.flac").write_bytes(b"audio")
    found = sorted(r["relative_path"] for r in catalogue.list_files(spark, str(root)).collect())
    assert found == sorted(["1.flac", f"x/{str(root).lstrip('/')}/9.flac"])


def test_listing_finds_files_of_any_name(spark, tmp_path):
    root = tmp_path / "lib"
    names = ["1.flac", "_New/02.flac", "x/_03.flac", "x/.h.flac", "x/.deep/_a#? %41/b c%20#?.MP3", "x/empty.m4a", "x/é/日本.aiff", "backupx/4.flac"]
    left_out = ["x/Backup_1/5.flac", "backup_2/y/6.flac", "x/note.txt", "x/noext"]
    for name in names + left_out:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else b"audio")
    (root / "folder.flac").mkdir()
    (root / "loop").symlink_to(root, target_is_directory=True)
    (root / "link.flac").symlink_to(root / "1.flac")
    found = {r["relative_path"]: r for r in catalogue.list_files(spark, str(root)).collect()}
    assert sorted(found) == sorted([*names, "link.flac"])
    assert found["x/.h.flac"]["full_path"] == f"file:{root}/x/.h.flac" and found["x/é/日本.aiff"]["format"] == "Id3"
    assert sorted(r["relative_path"] for r in catalogue.list_files(spark, str(root), [".txt"]).collect()) == ["x/note.txt"]
    (tmp_path / "nothing").mkdir()
    assert catalogue.list_files(spark, str(tmp_path / "nothing")).count() == 0


def test_listing_of_many_folders(spark, tmp_path):
    wanted = set()
    for folder in range(400):
        place = tmp_path / f"{folder % 7}" / f"_{folder}"
        place.mkdir(parents=True)
        for file in range(500 if folder == 3 else 20):
            (place / f"{file}.flac").touch()
            wanted.add(f"{folder % 7}/_{folder}/{file}.flac")
    found = [r["relative_path"] for r in catalogue.list_files(spark, str(tmp_path)).collect()]
    assert len(found) == len(wanted) and set(found) == wanted

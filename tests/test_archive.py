"""Saving, replacing and deleting meetings in an archive."""

import pytest

from colloquy.sinks.archive import Archive


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"))


def files(spark, *rows):
    return spark.createDataFrame([(folder, file, content) for folder, file, content in rows], "folder string, file string, content string")


def held(archive):
    return sorted(map(tuple, archive.files().collect()))


A, B, C = "2024-01-05_A_1", "2024-02-05_B_2", "2024-01-09_C_3"


def test_a_save_keeps_the_other_meetings_of_its_month(spark, archive):
    assert held(archive) == []
    archive.save(files(spark, (A, "a.json", "1"), (A, "a.md", "2"), (B, "b.json", "3")))
    archive.save(files(spark, (C, "c.json", "4")))
    assert held(archive) == [(A, "a.json", "1"), (A, "a.md", "2"), (C, "c.json", "4"), (B, "b.json", "3")]


def test_a_folder_saved_twice_is_one_with_the_later_files(spark, archive):
    archive.save(files(spark, (A, "old.json", "1"), (A, "a.md", "1"), (C, "c.json", "4")))
    archive.save(files(spark, (A, "a.md", "2")))
    assert held(archive) == [(A, "a.md", "2"), (C, "c.json", "4")]
    archive.save(files(spark).limit(0))
    assert held(archive) == [(A, "a.md", "2"), (C, "c.json", "4")]


def test_what_breaks_off_before_the_manifest_is_not_seen(spark, archive, monkeypatch):
    archive.save(files(spark, (A, "a.json", "1")))
    with monkeypatch.context() as broken:
        broken.setattr(archive, "_switch", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            archive.save(files(spark, (C, "c.json", "4")))
    assert held(archive) == [(A, "a.json", "1")]


def test_two_writers_do_not_lose_each_other(spark, archive, monkeypatch):
    other = Archive(spark, archive.root)
    archive.save(files(spark, (A, "a.json", "1")))
    switch, between = archive._switch, [lambda: other.save(files(spark, (B, "b.json", "2")))]

    def late(manifest):
        if between:
            between.pop()()  # the other one commits after this one has read the manifest
        return switch(manifest)

    monkeypatch.setattr(archive, "_switch", late)
    archive.save(files(spark, (C, "c.json", "3")))
    assert held(archive) == [(A, "a.json", "1"), (C, "c.json", "3"), (B, "b.json", "2")]
    assert [p["at"] for p in archive.manifest()["places"]] == [1, 2, 3]


def test_deleted_folders_are_passed_over_and_can_come_back(spark, archive):
    archive.save(files(spark, (A, "a.json", "1"), (B, "b.json", "2"), (C, "c.json", "3")))
    archive.delete(spark.createDataFrame([(A,), (A,), ("2024-01-01_nobody_9",)], "folder string"))
    assert held(archive) == [(C, "c.json", "3"), (B, "b.json", "2")]
    archive.save(files(spark, (A, "a.json", "new")))
    assert held(archive) == [(A, "a.json", "new"), (C, "c.json", "3"), (B, "b.json", "2")]


def test_purging_drops_dead_rows_and_can_be_repeated(spark, archive, monkeypatch):
    archive.save(files(spark, (A, "a.json", "1"), (B, "b.json", "2"), (C, "c.json", "3")))
    archive.delete(spark.createDataFrame([(A,)], "folder string"))
    before = {p["place"] for p in archive.manifest()["places"]}
    with monkeypatch.context() as broken:
        broken.setattr(archive, "_remove_retired", lambda: (_ for _ in ()).throw(OSError("half way")))
        with pytest.raises(OSError, match="half way"):
            archive.purge()
    assert held(archive) == [(C, "c.json", "3"), (B, "b.json", "2")]
    assert archive.manifest()["retired"]
    assert archive.purge() == 0 and archive.purge() == 0  # the month is tidy, the old places go
    assert held(archive) == [(C, "c.json", "3"), (B, "b.json", "2")]
    assert not archive.manifest()["retired"]
    raw = spark.read.option("recursiveFileLookup", "true").parquet(f"{archive.root}/data").count()
    assert raw == 2 and len(before & {p["place"] for p in archive.manifest()["places"]}) == 1


def test_a_save_during_a_purge_is_kept(spark, archive, monkeypatch):
    archive.save(files(spark, (A, "a.json", "1"), (C, "c.json", "3")))
    archive.delete(spark.createDataFrame([(A,)], "folder string"))
    other, replace = Archive(spark, archive.root), archive._replace
    between = [lambda: other.save(files(spark, (C, "c.json", "new"), (B, "b.json", "2")))]

    def late(old, written):
        if between:
            between.pop()()
        return replace(old, written)

    monkeypatch.setattr(archive, "_replace", late)
    archive.purge()
    assert held(archive) == [(C, "c.json", "new"), (B, "b.json", "2")]


def test_a_month_whose_meetings_are_all_deleted_goes(spark, archive):
    archive.save(files(spark, (A, "a.json", "1"), (B, "b.json", "2")))
    archive.delete(spark.createDataFrame([(A,)], "folder string"))
    archive.purge()
    assert held(archive) == [(B, "b.json", "2")]
    assert [p["place"][-7:] for p in archive.manifest()["places"]] == ["2024-02"]

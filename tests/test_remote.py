import hashlib
import json
from pathlib import Path

import pytest

from palimpsest.operators.judging import Busy
from palimpsest.sources import remote


class FolderSearch:
    """Serves pages from a folder's listing; short pages, and one busy answer a page."""

    def __init__(self, folder, most=1000, busy=False):
        self.folder, self.most, self.busy = str(folder), most, busy

    def names(self):
        return sorted(p.name for p in Path(self.folder).iterdir() if not p.name.startswith("."))

    def total(self, query):
        return len(self.names()), f"token of {query}"

    def page(self, token, start, size):
        assert token == "token of genes"
        mark = Path(self.folder) / f".busy-{start}"
        if self.busy and not mark.exists():
            mark.touch()
            raise Busy(0.0)
        return self.names()[start : start + min(size, self.most)]


class FolderStore:
    def __init__(self, folder):
        self.folder = str(folder)

    def list(self, prefix):
        if prefix == "PMC8.":
            raise OSError("down")
        return [f"{p.name}/" for p in Path(self.folder).iterdir() if p.name.startswith(prefix)]

    def get(self, key):
        with open(f"{self.folder}/.log", "a") as f:
            f.write(key + "\n")
        return (Path(self.folder) / key).read_bytes()


def quick(seconds):
    pass


@pytest.mark.parametrize(("cap", "size", "most"), [(1000, 10, 1000), (25, 10, 1000), (25, 7, 3), (0, 5, 5), (47, 47, 1000)])
def test_paged_search(spark, tmp_path, cap, size, most):
    for i in range(47):
        (tmp_path / f"PMC{i:03d}").touch()
    found = remote.search(spark, FolderSearch(tmp_path, most, busy=True), "genes", cap, size, sleep=quick)
    got = sorted(tuple(r) for r in found.ids.collect())
    assert got == [(i, f"PMC{i:03d}") for i in range(min(cap, 47))]
    assert found.total == 47 and found.truncated == (cap < 47)
    assert found.ids.rdd.getNumPartitions() == max(1, -(-min(cap, 47) // size))


def test_a_service_that_stays_away_fails(spark, tmp_path):
    slept = []
    with pytest.raises(RuntimeError, match="no answer after 4 tries"):
        remote.patient(lambda: (_ for _ in ()).throw(OSError("down")), sleep=slept.append)
    assert slept == [1.0, 2.0, 4.0]


@pytest.fixture
def store(tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()

    def put(name, version, text, **meta):
        d = folder / f"{name}.{version}"
        d.mkdir()
        (d / f"{name}.{version}.xml").write_text(text)
        (d / f"{name}.{version}.json").write_text(json.dumps(meta))

    put("PMC1", 1, "<a>old</a>")
    put("PMC1", 10, "<a>new</a>", license_code="CC BY", is_pmc_openaccess=True)
    put("PMC1", 9, "<a>older</a>")
    put("PMC2", 1, "<a>", is_open_access=True)
    put("PMC3", 2, "<a/>", is_pmc_openaccess=False, license="NO")
    (folder / "PMC4.1").mkdir()
    put("PMC12", 7, "<b/>")
    return FolderStore(folder)


def test_fetch_statuses_resumption_and_damage(spark, store, tmp_path):
    ids = spark.createDataFrame([(f"PMC{i}",) for i in (1, 1, 2, 3, 4, 5, 8)] + [(None,)], "pmcid string")
    corpus = remote.Corpus(spark, f"{tmp_path}/corpus")
    got = {r["pmcid"]: r for r in corpus.fetch(ids, store, 3, quick).collect()}
    assert len(got) == 6 and got["PMC1"]["version"] == 10 and got["PMC1"]["license_code"] == "CC BY" and got["PMC1"]["note"] == ""
    assert got["PMC1"]["sha256"] == hashlib.sha256(b"<a>new</a>").hexdigest() and got["PMC1"]["xml_bytes"] == 10
    assert got["PMC2"]["status"] == "ok" and got["PMC2"]["note"].startswith("warning")
    assert (got["PMC3"]["status"], got["PMC3"]["is_open_access"], got["PMC3"]["license_code"]) == ("skipped", False, "NO")
    assert got["PMC4"]["note"].startswith("metadata failed") and got["PMC5"]["note"] == "not in the store"
    assert got["PMC8"]["status"] == "error" and got["PMC8"]["note"].startswith("listing failed")
    assert {r["pmcid"]: bytes(r["content"]) for r in corpus.objects().collect()} == {"PMC1": b"<a>new</a>", "PMC2": b"<a>"}

    Path(store.folder, ".log").unlink()
    again = {r["pmcid"]: r for r in corpus.fetch(ids.union(spark.createDataFrame([("PMC12",)], "pmcid string")), store, 3, quick).collect()}
    asked = Path(store.folder, ".log").read_text()
    assert again["PMC1"]["note"] == "resumed" and again["PMC1"]["sha256"] == got["PMC1"]["sha256"] and "PMC1.10/" not in asked
    assert again["PMC12"]["status"] == "ok" and corpus.objects().count() == 3 and corpus.manifest().count() == 7

    # one whose object isn't what the manifest says is an error, not fetched over
    objects = spark.read.parquet(f"{tmp_path}/corpus/objects").selectExpr("pmcid", "version", "sha256", "case when pmcid = 'PMC1' then cast('bad' as binary) else content end as content")
    objects.write.parquet(f"{tmp_path}/other/objects")
    (tmp_path / "other" / "manifests").symlink_to(tmp_path / "corpus" / "manifests")
    bad = {r["pmcid"]: r for r in remote.Corpus(spark, f"{tmp_path}/other").fetch(ids, store, 3, quick).collect()}
    assert bad["PMC1"]["status"] == "error" and "another digest" in bad["PMC1"]["note"] and bad["PMC2"]["note"] == "resumed"


def test_metadata_is_best_effort(spark):
    def summaries(names):
        if "b3" in names:
            raise OSError
        return {n: {"title": f"T {n}", "pubdate": 2001} for n in names if n != "b0"}

    ids = spark.createDataFrame([(f"b{i}",) for i in range(5)], "pmcid string").coalesce(1)
    got = {r["pmcid"]: tuple(r)[1:] for r in remote.metadata(ids, summaries, 2).collect()}
    assert got == {"b1": ("T b1", "", "2001"), "b4": ("T b4", "", "2001")}

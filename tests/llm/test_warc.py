import gzip
import hashlib

from pyarrow import fs

from rejoinder.llm import warc as W
from rejoinder.llm.common import shared_folder

BIG = "é" * 600


def rows():
    return ([(i, f"http://h/{i} x\r\n", BIG if i % 3 else f"<p>{i}</p>") for i in range(60)]
            + [(100, None, None), (101, "u", ""), (102, "u", BIG + "!"), (103, "u", BIG + "!"), (103, "u", BIG + "!"),
               (None, "u", BIG), (None, None, "z"), (104, "u", "\r\n\r\nWARC/1.1\r\n" * 200)])


def brute(rs):
    kept = {}
    for p, _, h in rs:
        if p is not None and len((h or "").encode()) >= 1000:
            kept[h] = max(kept.get(h, p), p)
    out = []
    for p, _, h in rs:
        b = (h or "").encode()
        r = kept.get(h) if p is not None and len(b) >= 1000 and p < kept[h] else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if r is None else "revisit", r))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(W, "ROLL_BYTES", 2_000)
    df = spark.createDataFrame([(*r, 5) for r in rows()], "page_id long, url string, html string, shard int").repartition(4)
    assert sorted(map(tuple, W.write_and_read(spark, df).collect()), key=str) == brute(rows())


def test_files_are_the_same_whatever_the_partitioning_and_rolled(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(W, "ROLL_BYTES", 2_000)
    seen = []
    for n in (1, 7):
        folder = shared_folder(spark, "w")
        # repeated ids have no order of their own
        rs = [r for r in rows() if r[0] not in (None, 103)]
        manifest = W.write(spark.createDataFrame(rs, "page_id long, url string, html string").repartition(n), folder).collect()
        seen.append({(m.file, m.sha1, m.records) for m in manifest})
        system, path = fs.FileSystem.from_uri(folder)
        for m in manifest:
            data = system.open_input_stream(f"{path}/{m.file}", compression=None).read()
            assert hashlib.sha1(data).hexdigest() == m.sha1 and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert not system.get_file_info(fs.FileSelector(f"{path}/temporary"))
    assert seen[0] == seen[1] and len(seen[0]) > 3


def test_repeated_and_outlying_ids_make_the_same_files(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 20_000)
    rs = [*rows(), (-2**62, "u", BIG), (2**62, "v", BIG), (7, "b", "same"), (7, "a", "same"), (7, None, "same"), (7, "a", "same")]
    rs = [r for r in rs if r[0] is not None]
    seen = []
    for n in (1, 7):
        folder = shared_folder(spark, "w")
        df = spark.createDataFrame(rs, "page_id long, url string, html string").repartition(n)
        seen.append({(m.file, m.sha1, m.records) for m in W.write(df, folder).collect()})
        assert sorted(map(tuple, W.read(spark, folder).collect()), key=str) == brute(rs)
    assert seen[0] == seen[1] and max(m[2] for m in seen[0]) < len(rs) / 2


def test_a_very_long_page(spark):
    rs = [(1, "u", "<p>é" * 800_000), (2, "u", "<p>é" * 800_000), (3, "u", "x")]
    assert sorted(map(tuple, W.write_and_read(spark, spark.createDataFrame(rs, "page_id long, url string, html string")).collect()), key=str) == brute(rs)


def test_empty_table(spark):
    assert W.write_and_read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

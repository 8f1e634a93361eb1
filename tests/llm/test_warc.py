import glob
import gzip
import hashlib
import shutil

import pytest

from quillstone.llm.warc import Roller, parse, read_warc, write_warc

PAGES = "page_id long, url string, html string, n int, digest string, shard string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "s") for r in rows], PAGES).repartition(4)


def brute(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        revisit = len(p) >= 100 and first != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    same = "<p>é</p>" * 20
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else f"<p>{i % 50}</p>" * (i % 40)) for i in range(900)]
    rows += [(900, None, None), (901, "http://h/ä b\r\nX: y", ""), (902, "u", "x" * 300_000), (903, "u", "<html>\r\n\r\nWARC/1.1\r\n" * 10)]
    for name in ("a", "b"):
        root = f"file://{tmp_path}/{name}"
        manifest = write_warc(pages(spark, rows), root, shard_bytes=200_000, roll_bytes=2_000)
        got = sorted(map(tuple, read_warc(spark, root).collect()))
        assert got == brute(rows)
    files = {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/a/*.gz")}
    assert files == {f.rsplit("/", 1)[1]: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/b/*.gz")}
    assert {(r.file, r.bytes, r.sha256) for r in manifest.collect()} == {(f, len(b), hashlib.sha256(b).hexdigest()) for f, b in files.items()}
    assert len(files) > 4 and not glob.glob(f"{tmp_path}/a/_tmp*")
    head, payload = parse(next(iter(gzip.decompress(b) for b in files.values())))
    assert head["WARC-Type"] in ("response", "revisit") and "WARC-Date" in head


def test_unlisted_files_are_not_read(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    write_warc(pages(spark, [(1, "u", "x" * 200)]), root)
    (tmp_path / "c" / "part-stray.warc.gz").write_bytes(b"no archive")
    assert read_warc(spark, root).count() == 1


def test_repeats_nulls_and_empty_table(spark, tmp_path):
    long = "z" * 150
    write_warc(pages(spark, [(5, "u", long), (5, "u", long), (None, "u", long), (6, "u", "short"), (6, "u", "short")]), f"file://{tmp_path}/d")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in read_warc(spark, f"file://{tmp_path}/d").collect())
    assert got == [(0, "revisit", 5), (5, "response", None), (5, "revisit", 5), (6, "response", None), (6, "response", None)]
    write_warc(pages(spark, [(1, "u", "x")]).limit(0), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize(("parts", "coalesce"), [("1", "false"), ("8", "true"), ("24", "false"), ("211", "false")])
def test_a_shard_stays_in_one_task(spark, tmp_path, parts, coalesce):
    rows = [(i, f"http://h/{i}", "hot" * 50 if i % 3 == 0 else f"<p>{i}</p>" * 20) for i in range(3000)]
    confs = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.shuffle.partitions": parts}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        root = f"file://{tmp_path}/f"
        manifest = write_warc(pages(spark, rows), root, shard_bytes=200_000, roll_bytes=20_000).collect()
        got = sorted(map(tuple, read_warc(spark, root).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.file for r in manifest}) == len(manifest) and sum(r.records for r in manifest) == 3000
    hot = [i for i, _, h in rows if h.startswith("hot")]
    assert got == [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if i in hot[1:] else "response", 0 if i in hot[1:] else None) for i, _, h in rows]


def test_attempts_that_were_lost(spark, tmp_path):
    """What a lost attempt left is taken over or removed; a file that isn't as listed isn't read."""
    rows, root = [(i, "u", f"<p>{i}</p>" * 30) for i in range(50)], f"file://{tmp_path}/g"
    first = write_warc(pages(spark, rows), root, roll_bytes=500).collect()
    shutil.rmtree(tmp_path / "g" / "manifest")
    (tmp_path / "g" / "_tmp-0").write_bytes(b"half a record")
    assert sorted(write_warc(pages(spark, rows), root, roll_bytes=500).collect()) == sorted(first)
    assert not glob.glob(f"{tmp_path}/g/_tmp*") and read_warc(spark, root).count() == 50
    name = glob.glob(f"{tmp_path}/g/*.gz")[0]
    data = open(name, "rb").read()
    open(name, "wb").write(data + gzip.compress(gzip.decompress(data)))
    with pytest.raises(Exception, match="isn't the file that the manifest lists"):
        read_warc(spark, root).collect()


def test_a_file_of_other_contents_is_not_replaced(tmp_path):
    def write(data):
        roller = Roller(f"file://{tmp_path}", 100)
        roller.put("000000-000", data)
        roller.close()
        return roller.done

    assert write(b"x" * 10) == write(b"x" * 10)  # a repeated attempt
    with pytest.raises(ValueError):
        write(b"y" * 10)
    assert (tmp_path / "part-000000-000-00000.warc.gz").read_bytes() == b"x" * 10

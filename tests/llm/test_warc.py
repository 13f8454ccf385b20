"""The archive round trip against brute force: ties, repeated and null ids, sparse ids, clashing columns, no rows."""

import hashlib
import random

import pytest

from planwright.llm import warc
from planwright.session import materialize

SCHEMA = "page_id bigint, url string, html string, payload string, shard int, digest string"


def archived(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame([(*r, "other", 7, "clash") for r in rows], SCHEMA)
    folder = f"file://{tmp_path}/w"
    manifest = materialize(warc.write_shards(pages, folder, **options), "test-warc")
    out = warc.read_shards(manifest, folder)
    return manifest, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]


def brute(rows):
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= warc.REVISIT_BYTES:
            largest.setdefault(h, []).append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in largest.get(h, []) if x is not None]
        refers = max(ids) if len(largest.get(h, [])) > 1 and ids and (i is None or i < max(ids)) else None
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("step", [1, 10_000_019])
def test_against_brute_force(spark, tmp_path, step):
    rnd = random.Random(step)
    bodies = [None, "", "é" * 600, "x" * 999, "y" * 1000, "<p>ü</p>" * 300]
    rows = [(k * step - 50, f"http://h/{k}", rnd.choice(bodies)) for k in range(200)]
    rows += [(None, None, bodies[-1]), (None, "http://n", ""), (rows[0][0], "http://again", bodies[4]), (149 * step - 50, "http://tie", bodies[5]), (2**62, "u\r\nv", "z" * 2000), (2**62, "w", "z" * 2000)]
    manifest, got = archived(spark, rows, tmp_path, rows_per_shard=40, roll_bytes=20_000)
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert manifest.count() <= 12


def test_sparse_ids_make_few_files(spark, tmp_path):
    manifest, got = archived(spark, [(k * 10_000_019, "u", "a") for k in range(200)], tmp_path)
    assert manifest.count() == 1 and len(got) == 200


def test_no_rows(spark, tmp_path):
    manifest, got = archived(spark, [], tmp_path)
    assert manifest.count() == 0 and got == []


def test_one_far_id_makes_no_long_shard(spark, tmp_path):
    rows = [(k, "u", "a") for k in range(1000)] + [(2**62, "far", "b")]
    manifest, got = archived(spark, rows, tmp_path, rows_per_shard=100)
    sizes = sorted(r.n_records for r in manifest.collect())
    assert sizes == [1] + [100] * 10 and len(got) == 1001


def test_files_follow_from_the_records(spark, tmp_path):
    rows = [(k % 150, f"u{k}", f"text {k % 7}" * (k % 90)) for k in range(400)] + [(None, "n", "x")] * 130
    found = []
    for parts in (1, 7):
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
        manifest = warc.write_shards(pages, f"file://{tmp_path}/w{parts}", rows_per_shard=50)
        found.append(sorted(tuple(r) for r in manifest.collect()))
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == 530


def test_regions_hold_more_shards_where_there_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_REGIONS", 3)
    bounds, shards = warc.regions(spark.range(0, 200, 2).withColumnRenamed("id", "page_id").repartition(5), 10)
    assert (bounds, shards) == ([80, 160], 4)
    ids = spark.createDataFrame([(None,), (-5,), (79,), (80,), (159,), (160,), (2**62,)], "page_id bigint")
    out = {r[0]: r[1] for r in ids.select("page_id", warc.region_of(ids.page_id, bounds)).collect()}
    assert out == {None: 0, -5: 0, 79: 0, 80: 1, 159: 1, 160: 2, 2**62: 2}

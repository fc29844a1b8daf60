import zlib
from collections import defaultdict

from tidewin.llm import sharding as S


def test_bytes_are_near_equal_and_slots_gapless(spark, prose):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(400)]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(400))
    loads, slots = defaultdict(int), defaultdict(list)
    for r in out:
        text = rows[r.doc_id][1].encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= max(r.size for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_heaviest_first_matches_a_plain_loop(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 3 + i % 50)) for i in range(60)], "doc_id long, text string")
    loads = S.slot_loads(S.sized(docs, slots=32), 32)
    got = {r.virtual_slot: r.shard for r in S.first_map(loads, 3).collect()}
    state, want = [[0, 0, k] for k in range(3)], {}
    for r in sorted(loads.collect(), key=lambda r: (-r.bytes, r.virtual_slot)):
        low = min(state)
        want[r.virtual_slot] = low[2]
        low[0], low[1] = low[0] + r.bytes, low[1] + 1
    assert got == want


def test_rebalancing_moves_slots_only_to_the_new_shard(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(300)], "doc_id long, text string")
    first = S.first_map(S.slot_loads(S.sized(docs, slots=128), 128), 4)
    old = {r.virtual_slot: r for r in first.collect()}
    new = {r.virtual_slot: r for r in S.rebalance(first, 5).collect()}
    moved = [s for s in old if old[s].shard != new[s].shard]
    assert moved and all(new[s].shard == 4 for s in moved) and {r.version for r in new.values()} == {2}
    share = sum(new[s].bytes for s in moved) / sum(r.bytes for r in new.values())
    assert 0.1 < share <= 0.2


def test_new_loads_edit_the_stored_map(spark, prose, tmp_path):
    folder = f"file://{tmp_path}/maps"
    docs = spark.createDataFrame([(i, prose(i % 50, 10 + i % 40)) for i in range(3000)], "doc_id long, text string")
    few = docs.where("doc_id < 2970")
    at = lambda df: {r.doc_id: r.shard for r in df.collect()}
    loads = lambda df: [r[0] for r in df.groupBy("shard").agg(S.F.sum("size")).orderBy("shard").collect()]
    old, new = S.shard(few, folder=folder), S.shard(docs, folder=folder)
    assert {r.map_version for r in new.select("map_version").distinct().collect()} == {2}
    before, after = at(old), at(new)
    assert sum(before[i] != after[i] for i in before) < 0.02 * len(before)
    fullest = S.slot_loads(S.sized(docs)).agg(S.F.max("bytes")).first()[0]
    assert max(loads(new)) - min(loads(new)) <= 2 * fullest
    # Two shards fewer: only what they held moves, but for what evens the others out.
    fewer = S.shard(docs, 6, folder=folder)
    left = at(fewer)
    assert set(left.values()) == set(range(6)) and max(loads(fewer)) - min(loads(fewer)) <= 2 * fullest
    assert sum(after[i] != left[i] for i in after if after[i] < 6) < 0.02 * len(after)
    again = at(S.shard(docs, 8, folder=folder))  # and more again
    assert set(again.values()) == set(range(8)) and sum(again[i] != left[i] for i in left) < 0.3 * len(left)


def test_growth_moves_rows_only_to_the_new_shard(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    out = S.shard_growth(spark, "/root/testdata/sf0.001").collect()
    assert {r.grown_shard for r in out if r.grown_shard != r.shard} == {8} and {r.shard for r in out} == set(range(8))


def test_odd_and_empty_tables(odd, none, odd_rows):
    out = S.shard(odd).collect()
    assert len(out) == len(odd_rows) and {r.size for r in out if r.doc_id == 0} == {1}
    assert S.shard(none).count() == 0

"""Versioned user indexes: whole replacement, removal, pinned readers, both kinds of repair, positions."""

import duckdb
import pytest

from chunkloom.operators.neighbours import FLAT_BELOW
from chunkloom.plans.queries import QUERIES, SQL
from chunkloom.sources.indexes import UserIndexes

SCHEMA = "user_id long, chunk_id long, document_id long, vector array<double>"


def of(spark, rows):
    return spark.createDataFrame([(u, c, c // 10, [float(c), 1.0] if v else None) for u, c, v in rows], SCHEMA)


def held(indexes):
    return sorted((r.user_id, r.chunk_id) for r in indexes.rows().collect())


@pytest.fixture
def indexes(spark, tmp_path):
    return UserIndexes(spark, f"file://{tmp_path}/i").replace(of(spark, [(1, 10, 1), (1, 11, 1), (1, 12, 0), (2, 20, 1), (3, 30, 1)]))


def test_users_are_replaced_whole(spark, indexes, tmp_path):
    assert held(indexes) == [(1, 10), (1, 11), (2, 20), (3, 30)] and sorted((r.user_id, r.num_vectors, r.dimension, r.index_type) for r in indexes.users().collect()) == [(1, 2, 2, "flat"), (2, 1, 2, "flat"), (3, 1, 2, "flat")]
    later = indexes.replace(of(spark, [(1, 13, 1)]))
    assert held(later) == [(1, 13), (2, 20), (3, 30)] and held(indexes) == [(1, 10), (1, 11), (2, 20), (3, 30)]
    assert held(UserIndexes(spark, f"file://{tmp_path}/i")) == held(later) and [r.chunk_id for r in later.rows(1).collect()] == [13]


def test_a_user_without_vectors_has_no_index(spark, indexes):
    """Both ways: named without any row, and with rows that have no vector."""
    gone = indexes.replace(of(spark, []), spark.createDataFrame([(2,)], "user_id long")).replace(of(spark, [(3, 31, 0)]))
    assert held(gone) == [(1, 10), (1, 11)] and [r.user_id for r in gone.users().collect()] == [1]
    back = gone.replace(of(spark, [(2, 21, 1)])).compact()
    assert held(back) == [(1, 10), (1, 11), (2, 21)] and back.version.facts == {"segments": 1}
    assert back.store.vacuum(1) > 0 and held(back) == [(1, 10), (1, 11), (2, 21)]


def test_repair(spark, indexes):
    """Chunks that the index lacks, chunks that are no longer there, a user without an index, and nothing to do."""
    now = of(spark, [(1, 10, 1), (1, 11, 1), (2, 20, 1), (2, 21, 1), (4, 40, 1)])
    assert sorted(map(tuple, indexes.differences(now).collect())) == [(2, 21, "missing"), (3, 30, "stale"), (4, 40, "missing")]
    after = indexes.repair(now)
    assert held(after) == [(1, 10), (1, 11), (2, 20), (2, 21), (4, 40)] and after.differences(now).isEmpty() and after.repair(now) is after
    untouched = {r.user_id: r.segment for r in after.users().collect()}
    assert untouched[1] == 0 and untouched[2] == untouched[4] == 1


def test_positions(spark, tmp_path):
    rows = of(spark, [(u, 1000 * u + i, 1) for u in (1, 2) for i in range(150)])
    indexes = UserIndexes(spark, f"file://{tmp_path}/p").replace(rows)
    got = indexes.rows().collect()
    for user in (1, 2):
        assert sorted(r.position for r in got if r.user_id == user) == list(range(150))
    where = {(r.user_id, r.position): r.chunk_id for r in got}
    hits = spark.createDataFrame([(1, 5, 0.5), (2, 149, 0.4), (2, 150, 0.3), (9, 0, 0.2)], "user_id long, position long, score double")
    assert {(r.user_id, r.position, r.chunk_id) for r in indexes.chunk_ids(hits).collect()} == {(1, 5, where[1, 5]), (2, 149, where[2, 149])}


def test_nothing_yet(spark, tmp_path):
    none = UserIndexes(spark, f"file://{tmp_path}/n")
    assert held(none) == [] and none.users().collect() == [] and none.repair(of(spark, [])) is none
    assert held(none.repair(of(spark, [(1, 1, 1)]))) == [(1, 1)]


def test_large_index_as_sql(spark, tmp_path):
    """One user with just as many vectors as make an index of lists, others below: as the statement has it."""
    n = 3 * FLAT_BELOW - 8  # user 0 has the four of every third document, in full
    ids = spark.range(n).where(f"id div 4 % 3 = 0 or id < {n - 100}")
    ids.selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids.selectExpr("id as doc_id", "'a word' as text", "'en' as lang", "'src1' as source", "6L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for t in ("embeddings", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["q_index_repair"](spark, str(tmp_path))
    rows = db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['q_index_repair']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and {r.user_id: r.index_type for r in got.collect()} == {0: "ivf", 1: "flat", 2: "flat"}

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from salescope.operators import audit, audit_tree

DAY, OTHER = datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(DAY, n, json.dumps({"user": f"u{n}", "é": [n, "x"]})) for n in range(45)] + [(OTHER, 0, json.dumps({"user": "one"}))]
    return spark.createDataFrame(rows, "log_date date, at int, entry string")


@pytest.fixture(scope="module")
def chain(entries):
    return audit_tree.sharded_chain(entries, "key", ["at"], 4, F.col("at")).cache()


def root_of(leaves, fan, levels):
    nodes = leaves
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    assert len(nodes) == 1
    return nodes[0]


def test_one_shard_gives_the_bytes_of_the_plain_chain(entries):
    plain = audit.build_chain(entries, "key", ["at"])
    columns = ["log_date", "seq", "payload", "prev_hash", "hash"]
    one = audit_tree.sharded_chain(entries, "key", ["at"], 1)
    assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_shards_are_verified_each_on_its_own(chain):
    found = {(r.log_date, r.shard): (r.entries, r.intact, r.first_broken) for r in audit_tree.broken_shards(chain, "key").collect()}
    assert found == {(DAY, 0): (12, True, None), (DAY, 1): (11, True, None), (DAY, 2): (11, True, None), (DAY, 3): (11, True, None), (OTHER, 0): (1, True, None)}
    gone = chain.where(~((F.col("shard") == 1) & (F.col("seq") == 4)))
    assert [(r.shard, r.first_broken) for r in audit_tree.broken_shards(gone, "key").where("NOT intact").collect()] == [(1, 5)]


def test_roots_and_proofs(chain):
    tree = audit_tree.hash_tree(chain, fan=3).cache()
    rows = chain.orderBy("log_date", "shard", "seq").collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.log_date, r.shard), []).append(hashlib.sha256((r.payload + r.hash).encode()).hexdigest())
    # 12 entries need three levels of three; 4 shards need two
    shards = {k: root_of(v, 3, 3) for k, v in leaves.items()}
    wanted = {day: root_of([h for (d, _), h in sorted(shards.items()) if d == day], 3, 2) for day in (DAY, OTHER)}
    roots = {r.log_date: r.root for r in audit_tree.day_roots(tree).collect()}
    assert roots == wanted
    for at in (0, 20, 44):
        r = next(x for x in rows if x.log_date == DAY and x.shard == at % 4 and x.seq == at // 4)
        proof = audit_tree.inclusion_proof(tree, str(DAY), r.shard, r.seq, fan=3)
        assert len(proof) == 5 and all(len(hashes) <= 3 for _, hashes in proof)
        assert audit_tree.proves(r.payload, r.hash, proof, roots[DAY])
        assert not audit_tree.proves(r.payload.replace("u", "v"), r.hash, proof, roots[DAY])


def test_changes_are_located_from_the_trees(chain):
    trusted = audit_tree.hash_tree(chain, fan=3).cache()

    chain = chain.withColumn("at_end", ((F.col("shard") == 0) & (F.col("seq") == 11)).cast("int"))

    def located(present):
        return sorted(tuple(r) for r in audit_tree.changed_entries(trusted, audit_tree.hash_tree(present, fan=3), fan=3).collect())

    assert located(chain) == []
    hit = (F.col("log_date") == F.lit(DAY)) & (F.col("shard") == 2) & F.col("seq").isin(1, 7)
    assert located(chain.withColumn("payload", F.when(hit, "{}").otherwise(F.col("payload")))) == [(DAY, 2, 1), (DAY, 2, 7)]
    assert located(chain.where(hit | (F.col("log_date") == F.lit(DAY)) & (F.col("at_end") == 0)).drop("at_end")) == [(DAY, 0, 11), (OTHER, 0, 0)]


def test_empty_logs(chain):
    empty = audit_tree.hash_tree(chain.limit(0))
    assert empty.count() == 0 and audit_tree.day_roots(empty).count() == 0
    assert audit_tree.changed_entries(empty, empty).count() == 0

import collections
import random
import zlib

from pyspark.sql import functions as F

from repoatlas.llm import quality_rules, queries, sharding
from tests.compare import difference, duck
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import AWKWARD

_RNG = random.Random(2)
PROSE = "\n".join(" ".join("".join(_RNG.choices("aeinrst", k=6)) for _ in range(10)) + "." for _ in range(12))


def test_quality_rules_match_sql(spark):
    run, sql = queries.QUERIES["op1_quality_rules"], queries.ORACLE["op1_quality_rules"]
    assert difference(run(spark, SMALL), duck(SMALL), sql) is None


def test_lines_are_judged_first(table):
    menu = "Home | News | Sport | About us"
    notice = "This site uses cookies. Read our privacy policy."
    rows = [
        (1, PROSE),
        (2, PROSE + "\n" + menu + "\n" + notice),
        (3, "\n".join(f"{w} | x{n} | y{n} | z{n}" for n, w in enumerate(PROSE.split() * 2)) + "\n" + PROSE),
        (4, "\n".join(f"buy{n}*** now{n}$$$ item{n}### cheap{n}%%%" for n in range(40))),
        (5, PROSE.replace(".", "")),
    ]
    got = {r.doc_id: r for r in quality_rules.assess(table(rows)).collect()}
    assert got[1].kept and got[1].clean_text == PROSE and got[1].kept_share == 1
    assert got[2].kept and got[2].clean_text == PROSE
    assert not got[3].kept and not got[3].base_failed and got[3].clean_text == PROSE
    assert not got[4].kept and not got[5].kept
    cleaned = quality_rules.clean_documents(table(rows))
    assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == [(1, PROSE), (2, PROSE)]
    assert cleaned.columns == table(rows).columns


def test_quality_of_awkward_rows(awkward, empty):
    rows = quality_rules.quality_verdicts(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_words, by_id[1].kept, by_id[1].kept_share) == (0, False, 1.0)
    assert by_id[4].n_repeat_words == by_id[4].n_words == 30_000 and by_id[4].base_failed
    assert by_id[5].word_chars == 200_000
    assert quality_rules.quality_verdicts(empty).collect() == []
    assert quality_rules.clean_documents(awkward).columns == awkward.columns


def test_no_python_on_the_native_paths(awkward):
    for df in (quality_rules.quality_verdicts(awkward), sharding.assign_shards(awkward)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_shards_follow_the_published_algorithm(spark, texts):
    rows = queries.QUERIES["op8_jump_sharding"](spark, SMALL).collect()
    hashes = dict(spark.createDataFrame([(i,) for i in texts], "i long").select("i", F.xxhash64("i")).collect())
    slots = collections.defaultdict(list)
    for r in rows:
        key = hashes[r.doc_id] % 2**64
        assert (r.shard, r.grown_shard) == (brute.jump(key, 24), brute.jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == len(texts)


def test_shards_of_awkward_rows(awkward, empty, tmp_path):
    rows = sharding.shard_slots(awkward, shards=3).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(8, 0)}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_slots(empty).collect() == []
    sharding.write_shards(awkward.select("doc_id", "text"), str(tmp_path / "shards"), 3)
    back = awkward.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert collections.Counter(r.shard for r in back.collect()) == collections.Counter(r.shard for r in rows)


def test_slots_over_several_buckets(table):
    rows = sharding.assign_shards(table([(i, "t") for i in range(300)]), 2)
    got = sharding.number_slots(rows, 2, bucket_rows=10).collect()
    for shard in (0, 1):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))

"""Queries of vocabulary mining, the sliding window, tiers and promotion over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import tables
from textloom.operators import codecs, learning, shards, split, vocab

from textloom.sources import corpus

from .coding import PATTERNS, dealt_turns, turns
from .registry import query

#: Patterns are hexadecimal digits; dotted ones are compared for containment, as a dot keeps bytes aligned.
_GRAMS = """c AS (SELECT conv_id, turn, role, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM conversations),
  l AS (SELECT *, unnest(generate_series(4, least(32, n // 2))) AS len FROM c),
  g AS (SELECT *, unnest(generate_series(1, n - len + 1)) AS i FROM l),
  f AS (SELECT conv_id, turn, any_value(role) AS role, len, substr(h, 2 * i - 1, 2 * len) AS p, count(*) AS freq FROM g
        WHERE substr(h, 2 * i - 1, 2) >= '20' OR substr(h, 2 * i - 1, 2) = '0A' OR (substr(h, 2 * i - 1, 2) = '0D' AND i > 1)
        GROUP BY conv_id, turn, len, p HAVING count(*) >= 3)"""
_CANDIDATES = f"""{_GRAMS}, cand AS (SELECT *, (len - 2) * freq AS saving, row_number() OVER (PARTITION BY conv_id, turn ORDER BY (len - 2) * freq DESC, len DESC, p) AS place,
  regexp_replace(p, '(..)', '\\1.', 'g') AS dotted FROM f)"""
_MINED = f"""{_CANDIDATES}, mined AS (SELECT conv_id, turn, role, p, len, CAST(freq AS BIGINT) AS freq, CAST(saving AS BIGINT) AS saving, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) AS rank FROM cand a
  WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.place < a.place AND contains(b.dotted, a.dotted))) WHERE rank <= 200)"""
_ORDER = "saving DESC, len(p) DESC, p"
_WINDOW = f"""{_MINED}, win AS (SELECT conv_id, p, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving, max(turn) AS last_seen FROM mined WHERE saving >= 3 GROUP BY conv_id, p)"""


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.mined(dealt_turns(spark, sf_dir), ["conv_id", "turn", "role"])


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("pattern", F.hex("pattern"))


@query(f"WITH {_GRAMS} SELECT conv_id, turn, p AS pattern, freq AS n FROM f WHERE len = 8")
def ngram_counts_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = vocab.ngram_counts(turns(spark, sf_dir), ["conv_id", "turn"], "text", 8)
    return grams.withColumn("pattern", F.hex(F.encode("pattern", "ISO-8859-1")))


@query(f"WITH {_GRAMS} SELECT len, count(*) AS patterns, CAST(sum(freq) AS BIGINT) AS occurrences FROM f GROUP BY len")
def frequency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all lengths, how many patterns there are and how often they occur."""
    found = vocab.candidates(dealt_turns(spark, sf_dir), ["conv_id", "turn"])
    return found.groupBy(F.octet_length("pattern").cast("long").alias("len")).agg(F.count("*").alias("patterns"), F.sum("freq").cast("long").alias("occurrences"))


@query(f"WITH {_CANDIDATES} SELECT conv_id, turn, p AS pattern, freq, CAST(saving AS BIGINT) AS saving FROM cand")
def vocab_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.candidates(dealt_turns(spark, sf_dir), ["conv_id", "turn"])).drop("rank")


@query(f"""WITH {_CANDIDATES} SELECT conv_id, turn, p AS pattern, freq, CAST(saving AS BIGINT) AS saving FROM cand a
  WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.place < a.place AND contains(b.dotted, a.dotted))""")
def vocab_dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of all lengths that aren't inside a better one, however many."""
    return _hex(vocab.mined(dealt_turns(spark, sf_dir), ["conv_id", "turn"], limit=1 << 30)).drop("rank")


@query(f"WITH {_MINED} SELECT conv_id, turn, rank, p AS pattern, freq, saving FROM mined")
def vocab_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(mined(spark, sf_dir)).drop("role")


@query(f"WITH {_MINED}, t AS (SELECT p, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM mined WHERE NOT regexp_full_match(p, '(20|09|0A|0D)*') GROUP BY p) SELECT p AS pattern, freq, saving, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM t QUALIFY rank <= 5000")
def static_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.static_dictionary(mined(spark, sf_dir)))


@query(f"WITH {_MINED}, t AS (SELECT p, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM mined GROUP BY p) SELECT p AS pattern, freq, saving FROM t ORDER BY {_ORDER} LIMIT 20")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    total = mined(spark, sf_dir).groupBy("pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving"))
    return _hex(total.orderBy(*vocab.ordered()).limit(20))


_PRESEED = ", ".join(f"('{e.pattern.hex().upper()}', {e.freq}, {e.saving})" for e in codecs.preseed("text"))


def preseeded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(bytearray(e.pattern), e.freq, e.saving) for e in codecs.preseed("text")], "pattern binary, freq long, saving long")


@query(f"""WITH {_MINED}, pre(p, freq, saving) AS (VALUES {_PRESEED}), t AS (SELECT p, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM mined GROUP BY p),
  u AS (SELECT * FROM pre UNION ALL SELECT * FROM t WHERE p NOT IN (SELECT p FROM pre))
SELECT p AS pattern, freq, saving, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM u QUALIFY rank <= 200""")
def preseed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = mined(spark, sf_dir).groupBy("pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving"))
    return _hex(vocab.merged(preseeded(spark), total))


@query(f"WITH {_WINDOW} SELECT conv_id, p AS pattern, freq, saving, last_seen, row_number() OVER (PARTITION BY conv_id ORDER BY {_ORDER}) AS rank FROM win")
def window_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.window(mined(spark, sf_dir), ["conv_id"], "turn"))


@query(f"WITH {_MINED} SELECT conv_id, turn, p AS pattern, CAST(sum(freq) OVER w AS BIGINT) AS freq, CAST(sum(saving) OVER w AS BIGINT) AS saving FROM mined WHERE saving >= 3 WINDOW w AS (PARTITION BY conv_id, p ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def window_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.window_as_of(mined(spark, sf_dir), ["conv_id"], "turn"))


@query(f"WITH {_WINDOW}, t AS (SELECT conv_id, count(DISTINCT turn) AS batches FROM conversations GROUP BY conv_id) SELECT t.conv_id, count(win.p) AS entries, any_value(batches) AS batches FROM t LEFT JOIN win ON win.conv_id = t.conv_id GROUP BY t.conv_id")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = vocab.window(mined(spark, sf_dir), ["conv_id"], "turn").groupBy("conv_id").agg(F.count("*").alias("n"))
    batches = turns(spark, sf_dir).groupBy("conv_id").agg(F.countDistinct("turn").alias("batches"))
    return batches.join(entries, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("entries"), "batches")


@query(f"""WITH {_MINED}, pre(p, freq, saving) AS (VALUES {_PRESEED}), u AS (SELECT p, freq, saving FROM mined WHERE saving >= 3 UNION ALL SELECT p, freq, saving FROM pre WHERE saving >= 3 UNION ALL SELECT '637265646974', 7, 28)
SELECT p AS pattern, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM u GROUP BY p""")
def window_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that starts from a static dictionary and is credited with one pattern."""
    credit = spark.createDataFrame([(bytearray(b"credit"), 7, 28)], "pattern binary, freq long, saving long")
    every = mined(spark, sf_dir).select("pattern", "freq", "saving").unionByName(preseeded(spark)).unionByName(credit).withColumn("batch", F.lit(0))
    return _hex(vocab.window(every, [], "batch", 1 << 30)).select("pattern", "freq", "saving")


@query("""SELECT conv_id, turn, CAST(coalesce(list_count(x), 0) AS BIGINT) AS learned, coalesce(sha256(array_to_string(x, chr(10))), sha256('')) AS history_sha256
FROM (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS x FROM conversations) WHERE length(text) >= 200""")
def pressurize_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the window learns again before a long turn: the three turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    h = turns(spark, sf_dir).withColumn("x", F.collect_list("text").over(w)).where(F.length("text") >= 200)
    return h.select("conv_id", "turn", F.size("x").cast("long").alias("learned"), F.sha2(F.array_join("x", "\n"), 256).alias("history_sha256"))


@query("""SELECT conv_id, turn, r, r % 4 = 0 AS learns, CASE WHEN r < 100 THEN r // 50 ELSE 1 + (r - 50) // 100 END AS generation FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations)""")
def learn_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks of one stream learn, and the vocabulary's generation after each: rebuilt after 50 chunks, from 100 on after 100."""
    placed, _ = tables.numbered(turns(spark, sf_dir).select("conv_id", "turn"), ["conv_id", "turn"], "place")
    n = placed.select("conv_id", "turn", (F.col("place") + 1).alias("r"))
    return n.withColumn("learns", F.col("r") % 4 == 0).withColumn("generation", F.expr("if(r < 100, r div 50, 1 + (r - 50) div 100)"))


@query(f"WITH {_MINED} SELECT conv_id, turn, p AS pattern, freq, saving, row_number() OVER (PARTITION BY conv_id, turn ORDER BY {_ORDER}) AS rank FROM mined WHERE saving >= 2 QUALIFY rank <= 63")
def tier_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.tier_three(mined(spark, sf_dir), ["conv_id", "turn"])).drop("role")


_L3 = f"{_MINED}, l3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY {_ORDER}) AS r3 FROM mined WHERE saving >= 2 QUALIFY r3 <= 63)"
_L2 = f"{_L3}, l2 AS (SELECT role, p, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM l3 WHERE freq >= 2 GROUP BY role, p)"
_L1 = f"{_L2}, l1 AS (SELECT role, p, freq, saving, row_number() OVER (PARTITION BY role ORDER BY {_ORDER}) AS rank FROM l2 WHERE freq >= 8 QUALIFY rank <= 64)"


@query(f"WITH {_L3} SELECT conv_id, p AS pattern, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM l3 WHERE freq >= 2 GROUP BY conv_id, p")
def promote_l3_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(vocab.promoted_to_two(vocab.tier_three(mined(spark, sf_dir), ["conv_id", "turn"]), "conv_id"))


def _tier_one(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    two = vocab.promoted_to_two(vocab.tier_three(mined(spark, sf_dir), ["conv_id", "turn"]), "role")
    none = spark.createDataFrame([], "role string, pattern binary, freq long, saving long")
    return two, vocab.promoted_to_one(two, none, "role")


@query(f"WITH {_L1} SELECT role, p AS pattern, freq, saving, rank FROM l1")
def promote_l2_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(_tier_one(spark, sf_dir)[1])


_TIERS = f"""{_L1}, pre(p, freq, saving) AS (VALUES {_PRESEED}), tiers AS (
  (SELECT r.role, 0 AS tier, p, freq, saving, row_number() OVER (PARTITION BY r.role ORDER BY {_ORDER}) AS rank FROM pre CROSS JOIN (SELECT DISTINCT role FROM conversations) r QUALIFY rank <= 63) UNION ALL
  (SELECT role, 1, p, freq, saving, row_number() OVER (PARTITION BY role ORDER BY {_ORDER}) AS rank FROM l1 QUALIFY rank <= 64) UNION ALL
  (SELECT role, 2, p, freq, saving, row_number() OVER (PARTITION BY role ORDER BY {_ORDER}) AS rank FROM l2 QUALIFY rank <= 64))"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers of every role: the given patterns, then those promoted."""
    two, one = _tier_one(spark, sf_dir)
    roles = turns(spark, sf_dir).select("role").distinct()
    given = roles.select("role", F.explode(F.array(*(F.struct(F.lit(bytearray(e.pattern)).alias("pattern"), F.lit(e.freq).cast("long").alias("freq"), F.lit(e.saving).cast("long").alias("saving")) for e in codecs.preseed("text")))).alias("e")).select("role", "e.*")
    return vocab.tiers([given, one, two], ["role"])


@query(f"WITH {_TIERS} SELECT role, tier, p AS pattern, freq, saving, row_number() OVER (PARTITION BY role ORDER BY tier, rank) AS token_id FROM tiers")
def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(_tiers(spark, sf_dir))


@query(f"WITH {_TIERS} SELECT role, tier, count(*) AS entries, CAST(sum(saving) AS BIGINT) AS saving FROM tiers GROUP BY ALL")
def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).groupBy("role", "tier").agg(F.count("*").alias("entries"), F.sum("saving").cast("long").alias("saving"))


@query(f"""WITH {_MINED}, alt AS (SELECT conv_id, turn, string_agg(regexp_replace(p, '(..)', '\\1[.]', 'g'), '|' ORDER BY len DESC, p) AS a FROM mined GROUP BY conv_id, turn),
  hits AS (SELECT c.conv_id, c.turn, unnest(list_distinct(regexp_extract_all(regexp_replace(hex(encode(text)), '(..)', '\\1.', 'g'), a))) AS hit FROM conversations c JOIN alt USING (conv_id, turn))
SELECT m.conv_id, m.turn, m.rank, p AS pattern, freq, saving FROM mined m JOIN hits h ON h.conv_id = m.conv_id AND h.turn = m.turn AND replace(h.hit, '.', '') = p""")
def prune_to_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every turn's vocabulary the entries that its encoding uses."""
    return _hex(vocab.fired(dealt_turns(spark, sf_dir), ["conv_id", "turn"]))


@query(f"""WITH {_MINED} SELECT c.conv_id, c.turn, CAST(count(m.p) AS BIGINT) AS entries, CAST(coalesce(sum(m.saving), 0) AS BIGINT) AS saving, coalesce(string_agg(p, ',' ORDER BY rank), '') AS patterns
  FROM conversations c LEFT JOIN mined m ON m.conv_id = c.conv_id AND m.turn = c.turn GROUP BY c.conv_id, c.turn""")
def window_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's vocabulary as a snapshot's bytes, itself compressed, and what is read back from it."""

    def there_and_back(data: bytes) -> dict:
        back = codecs.load_window(codecs.decompress(codecs.compress(codecs.dump_window(codecs.mine(data)))))
        return {"entries": len(back), "saving": sum(e.saving for e in back), "patterns": ",".join(e.pattern.hex().upper() for e in back)}

    kind = "struct<entries:bigint,saving:bigint,patterns:string>"
    return dealt_turns(spark, sf_dir).select("conv_id", "turn", split.byte_udf(there_and_back, kind)(F.encode("text", "UTF-8")).alias("s")).select("conv_id", "turn", "s.*")


@query(f"""WITH {_L3}, k AS (SELECT conv_id, turn, count(*) AS n FROM l3 GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, sha256(text) AS restored_sha256, octet_length(encode(text)) AS n_bytes, CAST(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS BIGINT) AS shard_code, CAST(7 AS BIGINT) AS version, CAST(coalesce(n, 0) AS BIGINT) AS own_entries
FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn""")
def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_roundtrip(dealt_turns(spark, sf_dir), PATTERNS)


_LEARNED = f"""{_MINED}, w AS (SELECT conv_id, turn, p, row_number() OVER (PARTITION BY conv_id, p ORDER BY turn) AS k FROM mined WHERE saving >= 3),
  fresh AS (SELECT conv_id, turn, count(*) AS n FROM w WHERE k = 1 GROUP BY conv_id, turn),
  v AS (SELECT c.conv_id, c.turn, text, row_number() OVER x - 1 AS version, coalesce(sum(n) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entries
    FROM conversations c LEFT JOIN fresh f ON f.conv_id = c.conv_id AND f.turn = c.turn WINDOW x AS (PARTITION BY c.conv_id ORDER BY c.turn))"""


@query(f"WITH {_LEARNED} SELECT conv_id, turn, CAST(version AS BIGINT) AS version, CAST(entries AS BIGINT) AS entries, sha256(text) AS restored_sha256, octet_length(encode(text)) AS covered FROM v")
def learn_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn encoded with what its conversation's window learned from the turns before it, and decoded by a reader that
    has the codes alone and learns from what it decodes. The frame's version is how many turns were learned."""
    coded = learning.learn_encode(turns(spark, sf_dir), "conv_id", "turn", "text")
    back = learning.learn_decode(coded, "conv_id", "turn")
    return back.select("conv_id", "turn", "version", "entries", F.sha2("data", 256).alias("restored_sha256"), "covered")


def _frozen_roundtrip(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    t = dealt_turns(spark, sf_dir).withColumn("version", 1 + F.col("conv_id") % 3)
    learned = vocab.mined(t, ["conv_id", "turn", "version"])
    pinned = vocab.top(learned.where("saving >= 3").groupBy("version", "pattern").agg(F.sum("freq").alias("freq"), F.sum("saving").alias("saving")), ["version"], learning.PINNED)
    pinned = tables.written(pinned, "pinned")
    coded = learning.frozen_encode(t, pinned, "text", form)
    back = learning.decode_by_version(coded.select("conv_id", "turn", "code"), pinned, form)
    return back.select("conv_id", "turn", "version", F.sha2("data", 256).alias("restored_sha256"), "covered")


_FROZEN = "SELECT conv_id, turn, 1 + (conv_id % 3) AS version, sha256(text) AS restored_sha256, octet_length(encode(text)) AS covered FROM conversations"


@query(_FROZEN)
def frozen_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded against pinned versions of a vocabulary, here one a third of the conversations, and decoded by the version
    that each frame carries."""
    return _frozen_roundtrip(spark, sf_dir, "codon")


@query(_FROZEN)
def frozen_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in split form v4."""
    return _frozen_roundtrip(spark, sf_dir, "v4")


@query(_FROZEN)
def frozen_interleaved_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the interleaved form."""
    return _frozen_roundtrip(spark, sf_dir, "interleaved")


@query()
def general_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 best patterns of all documents, mined in chunks of 65,536 bytes. Without SQL, which would take hours:
    tests/test_vocab.py has brute force."""
    tables.bounded(spark)
    docs = tables.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    parts = corpus.chunks(docs.where("text is not null"), ["doc_id"], F.encode("text", "UTF-8"))
    return _hex(vocab.static_dictionary(vocab.mined(parts, ["doc_id", "chunk"], "data")))


@query("SELECT conv_id, turn, sha256(text) AS restored_sha256, octet_length(encode(text)) AS covered FROM conversations")
def window_v1_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small window: learns each turn, evicts, encodes in two passes with the vocabulary in the header; decoding needs
    no window."""
    coded = learning.window_encode(turns(spark, sf_dir), "conv_id", "turn", "text")
    kind = "struct<data:binary,covered:bigint>"
    back = coded.select("conv_id", "turn", split.byte_udf(lambda c: {"data": codecs.detokenize(c), "covered": codecs.token_facts(c)[0]}, kind)("code").alias("b"))
    return back.select("conv_id", "turn", F.sha2("b.data", 256).alias("restored_sha256"), "b.covered")


@query(f"""WITH {_MINED}, b AS (SELECT conv_id, turn, text, list(turn) OVER x AS again FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  times AS (SELECT conv_id, turn, unnest(again) AS learned FROM b WHERE length(text) >= 200 UNION ALL SELECT conv_id, turn, turn FROM b)
SELECT m.conv_id, p AS pattern, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(saving) AS BIGINT) AS saving FROM mined m JOIN times t ON t.conv_id = m.conv_id AND t.learned = m.turn WHERE saving >= 3 GROUP BY m.conv_id, p""")
def pressurized_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window when, before each turn of 200 characters or more, the three turns before it are learned once more."""
    t = turns(spark, sf_dir)
    again = F.collect_list("turn").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    pressed = t.select("conv_id", "text", again.alias("again")).where(F.length("text") >= 200).select("conv_id", F.explode("again").alias("turn")).groupBy("conv_id", "turn").agg(F.count("*").alias("times"))
    entries = mined(spark, sf_dir).join(pressed, ["conv_id", "turn"], "left").withColumn("times", 1 + F.coalesce("times", F.lit(0)))
    weighted = entries.where("saving >= 3").select("conv_id", "turn", "pattern", (F.col("freq") * F.col("times")).alias("freq"), (F.col("saving") * F.col("times")).alias("saving"))
    return _hex(vocab.window(weighted, ["conv_id"], "turn", 1 << 30)).select("conv_id", "pattern", "freq", "saving")

"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, mixing, quality, sharding, simhash, substring_dedup, suffix_dedup, token_files
from .common import Workspace, documents


def tokenizer_path() -> str:
    """The tokenizer file that the contracts name; elsewhere pass another path to the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The first id that the tokenizer never makes, so no text holds it.
SEPARATOR = 49408


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'tokens').path}/ids"
    token_files.write_parquet(documents(spark, sf_dir), path, tokenizer_path())
    return token_files.checksums(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document (with the end id), counted in flat files that hold ids alone."""
    ws = Workspace(spark, "flat")
    folder, manifest = token_files.write_flat(ws, documents(spark, sf_dir), tokenizer_path(), SEPARATOR)
    counts = token_files.scan_separators(ws, folder, manifest.select("file").distinct(), SEPARATOR)
    return manifest.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards and places: where the tree puts each copy that is taken."""
    planned = mixing.plan(documents(spark, sf_dir))
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"), F.transform("draws", lambda d: d["place"]).alias("places"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_feistel_sharding": op5_feistel_sharding,
    "op6_token_parquet": op6_token_parquet,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
}

def _feistel_sql(shards: int = sharding.SHARDS) -> str:
    """The law `rows` in SQL: numbers of the rows by doc_id, the same network in 64-bit arithmetic, walked until below the row count; CRC-32 by bytes."""
    keys = [int(k) for k in sharding.Feistel(2).keys]
    side = "SELECT row, k, half, x >> half AS l, x & ((1::UBIGINT << half) - 1) AS r FROM walk, c WHERE k = 0 OR x >= n"
    for key in keys:
        mixed = f"((r::UHUGEINT + {key}::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT % {1 << 64}::UHUGEINT)::UBIGINT"
        round_ = f"((xor(y, y >> 31)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT % {1 << 64}::UHUGEINT)::UBIGINT >> (64 - half))"
        side = f"SELECT row, k, half, r AS l, xor(l, {round_}) AS r FROM (SELECT *, {mixed} AS y FROM ({side}))"
    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, encode(coalesce(text, '')) AS x, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
        c AS (SELECT count(*) AS n, greatest(1, (len(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS half FROM t),
        walk AS (SELECT row, row::UBIGINT AS x, 0 AS k FROM t UNION ALL SELECT row, (l << half) | r, k + 1 FROM ({side})),
        placed AS (SELECT row, max_by(x, k)::BIGINT AS p FROM walk GROUP BY row),
        remainders AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))) AS part),
        bytes AS (SELECT doc_id, row, octet_length(x) + 1 AS size, list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM t)
        SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda v, y: xor(v >> 8, part[(xor(v, y) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
               'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard
        FROM bytes JOIN placed USING (row), remainders
    """


def _simhash_sql() -> str:
    """XXH64 of each distinct shingle in 64-bit arithmetic, bits by majority, all pairs of fingerprints and all that can be reached.

    The five primes are fixed values of XXH64.
    """
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    seed, top = simhash.SEED, 1 << 64
    low = lambda x: f"(({x}) % {top}::UHUGEINT)"  # noqa: E731  all numbers here are UHUGEINT below 2**64
    times = lambda x, k: low(f"{x} * {k % top}::UHUGEINT")
    plus = lambda x, y: low(f"{x} + {y}")
    turn = lambda x, r: f"({times(x, 1 << r)} + ({x} // {1 << (64 - r)}::UHUGEINT))"
    number = lambda k: f"{k % top}::UHUGEINT"
    steps: list[str] = ["SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)"]
    known: set[str] = set()

    def step(**new: str) -> None:
        """One more level for new or changed columns, so that no expression is written out twice over."""
        shown = ", ".join(f"{e} AS {c}" for c, e in new.items())
        steps.append(f"SELECT * REPLACE ({shown}) FROM ({steps[-1]})" if new.keys() <= known else f"SELECT *, {shown} FROM ({steps[-1]})")
        known.update(new)

    bytes_of = lambda at, many: "('0x' || " + " || ".join(f"substr(h, ({at}) * 2 + {2 * j + 1}, 2)" for j in reversed(range(many))) + ")::UBIGINT::UHUGEINT"
    reduced = lambda first, items, body: f"list_reduce(list_prepend({first}, {items}), lambda a, b: {body})"
    step(lanes=f"list_transform(range(n // 8), lambda i: {bytes_of('8 * i', 8)})", striped="n // 32")
    mixed = lambda a, b: f"{plus(a, times(b, p2))}"
    for j, init in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1)):
        step(**{f"v{j}": reduced(number(init), f"list_transform(range(striped), lambda i: lanes[4 * i + {j + 1}])", times(turn(mixed("a", "b"), 31), p1))})
    step(x=f"CASE WHEN n < 32 THEN {number(seed + p5)} ELSE {low(' + '.join(turn(f'v{j}', r) for j, r in enumerate((1, 7, 12, 18))))} END")
    for j in range(4):
        step(k=times(turn(times(f"v{j}", p2), 31), p1))
        step(x=f"CASE WHEN n < 32 THEN x ELSE {plus(times('xor(x, k)', p1), number(p4))} END")
    step(x=plus("x", "n::UHUGEINT"))
    step(rest=f"list_transform(lanes[4 * striped + 1:], lambda b: {times(turn(times('b', p2), 31), p1)})")
    step(x=reduced("x", "rest", plus(times(turn("xor(a, b)", 27), p1), number(p4))))
    step(k=f"CASE WHEN n % 8 >= 4 THEN xor(x, {times(bytes_of('n // 8 * 8', 4), p1)}) END")
    step(x=f"CASE WHEN n % 8 >= 4 THEN {plus(times(turn('k', 23), p2), number(p3))} ELSE x END")
    step(tail=f"list_transform(range(n // 4 * 4, n), lambda i: {times(bytes_of('i', 1), p5)})")
    step(x=reduced("x", "tail", times(turn("xor(a, b)", 11), p1)))
    for shift, prime in ((33, p2), (29, p3), (32, 1)):
        step(x=times(f"xor(x, x // {1 << shift}::UHUGEINT)", prime))
    bits = " + ".join(f"CASE WHEN 2 * sum((x >> {b}) & 1) > count(x) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (SELECT doc_id, array_to_string(w[i:i + {simhash.SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {simhash.SHINGLE - 2}))) AS i FROM t WHERE len(w) > 0)),
        hashes AS MATERIALIZED (SELECT s, x::UBIGINT AS x FROM ({steps[-1]})),
        prints AS MATERIALIZED (SELECT t.doc_id, ({bits})::UBIGINT AS f FROM t LEFT JOIN shingles USING (doc_id) LEFT JOIN hashes USING (s) GROUP BY t.doc_id),
        nodes AS MATERIALIZED (SELECT f, min(doc_id) AS low FROM prints GROUP BY f),
        links AS MATERIALIZED (SELECT a.f AS a, b.f AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.f, b.f)::BIT) <= {simhash.RADIUS} AND a.f <> b.f),
        reach AS (SELECT f AS a, f AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, component_id
        FROM prints JOIN (SELECT reach.a, min(low) AS component_id FROM reach JOIN nodes ON nodes.f = reach.b GROUP BY reach.a) ON a = f
    """


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)
    """,
    "op2_quality": r"""
        WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (
            SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(x) AS chars,
                   [length(regexp_replace(x, '[^a-z]', '', 'g')), length(regexp_replace(x, '[^A-Z]', '', 'g')), length(regexp_replace(x, '[^0-9]', '', 'g')), length(regexp_replace(x, '[^ \t]', '', 'g')),
                    length(regexp_replace(x, '[^\n\r\x0b\x0c]', '', 'g')), length(regexp_replace(x, '[^.,;:!?]', '', 'g')), length(regexp_replace(x, '[^''"()\-]', '', 'g')), length(regexp_replace(x, '[\x00-\x7f]', '', 'g'))] AS c FROM t),
        ln AS (SELECT doc_id, count(*) - count(DISTINCT y) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS y FROM t) WHERE regexp_matches(y, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5))),
        rp AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
        cl AS (SELECT doc_id, lang, chars, unnest(list_append(c, chars - list_sum(c))) AS n, unnest(range(9)) AS k FROM b),
        cq AS (SELECT lang, k, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM cl GROUP BY lang, k),
        cd AS (SELECT doc_id, sqrt(greatest(least(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 1), 0)) AS class_distance
               FROM (SELECT doc_id, n / greatest(chars, 1) AS p, q FROM cl JOIN cq ON cl.lang IS NOT DISTINCT FROM cq.lang AND cl.k = cq.k) GROUP BY doc_id),
        wc AS (SELECT doc_id, lang, y, count(*) AS n FROM (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y FROM t) GROUP BY ALL),
        lt AS (SELECT lang, sum(len(w)) AS total FROM t GROUP BY lang),
        top AS (SELECT lang, y, n / total AS q FROM (SELECT wc.lang, y, sum(n) AS n, any_value(total) AS total FROM wc JOIN lt ON wc.lang IS NOT DISTINCT FROM lt.lang GROUP BY wc.lang, y HAVING sum(n) >= 0.004::DOUBLE * any_value(total)) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, y) <= 48),
        pq AS (SELECT b.doc_id, coalesce(wc.n, 0) / greatest(n_words, 1) AS p, q FROM b JOIN top ON b.lang IS NOT DISTINCT FROM top.lang LEFT JOIN wc ON wc.doc_id = b.doc_id AND wc.y = top.y),
        pr AS (SELECT doc_id, p, q FROM pq UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM pq GROUP BY doc_id),
        wd AS (SELECT doc_id, sqrt(greatest(least(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 1), 0)) AS word_distance FROM pr GROUP BY doc_id),
        s AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, coalesce(word_distance, 0) AS word_distance, chars,
                     n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM b LEFT JOIN ln USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed,
               NOT base_failed AND NOT (class_distance > 0.3::DOUBLE AND chars >= 200) AND NOT (word_distance > 0.42::DOUBLE AND n_words >= 60) AS kept FROM s
    """,
    "op3_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
        low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN low USING (h) WHERE low < doc_id),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM t),
        kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS body, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
        SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
    """,
    "op4_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 398)) AS i FROM t WHERE len(x) >= 800)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
        cut AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS new FROM hit),
        run AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut) GROUP BY doc_id, k),
        own AS (SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS gone FROM run GROUP BY doc_id),
        gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, 0, 1 FROM t)),
        kept AS (SELECT t.doc_id, string_agg(substr(x, 2 * a - 1, CASE WHEN b IS NULL THEN len(x) ELSE 2 * (b - a) END), '' ORDER BY a) AS body FROM t JOIN gap USING (doc_id) GROUP BY t.doc_id)
        SELECT t.doc_id, len(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(body, ''))) AS kept_sha256
        FROM t LEFT JOIN own USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op5_feistel_sharding": _feistel_sql(),
    "op10_simhash": _simhash_sql(),
}

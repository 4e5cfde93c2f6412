"""The registered curation queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.hashes import block_bounds, block_keys
from ..functions.vectors import centroid
from ..operators import calibration, clusters, duplicates, gates, matching, progress, review, selection
from ..sources import cache, files, journal, reports
from . import curation
from .fixtures import DOCS_SQL, ITEMS_SQL, MATCHED_SQL, REFS_SQL, TARGET_SQL, documents, items, references, table, tiles
from .policy import PROFILES, Choice, Limits, Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: No item of the test tables is near enough for a named mode.
LIMITS, EIGHT = Limits(match=0.55), Choice(8)
#: The whole flow chooses the default hundred; EIGHT is small as its SQL is unrolled pick by pick.
FULL_POLICY = Policy(LIMITS)


def query(sql: str | None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# sources and sinks


#: Endings of the documents' made-up file names.
ENDINGS = (".JPG", ".txt", ".png", "", ".webp", ".gif", ".Tiff", ".bmp.part")


@query(f"""SELECT path, doc_id FROM (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') || ({list(ENDINGS)})[(doc_id % {len(ENDINGS)} + 1)::INT] AS path FROM documents)
    WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp|tif|tiff)$')""")
def scan_supported(spark, sf):
    """Documents under file names of all kinds: the supported ones."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return documents_bare(spark, sf).select(F.concat("path", ending).alias("path"), "doc_id").where(files.supported(F.col("path")))


@query("SELECT doc_id, sha256(text) AS fingerprint, strlen(text)::BIGINT AS size_bytes FROM documents")
def fingerprint_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source || '/' || lpad(doc_id::VARCHAR, 8, '0'))::BIGINT AS item_index FROM documents")
def ordered_scan(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"))
    return files.indexed(d).select("doc_id", F.col("item_index").cast("long").alias("item_index"))


SPACE_SQL = """
    SELECT count(*) AS files, sum(s)::BIGINT AS source_bytes, {copy}::BIGINT AS copy_bytes, greatest(268435456, floor(sum(s) * 0.05::DOUBLE)::BIGINT)::BIGINT AS reserve_bytes,
           ({copy} + greatest(268435456, floor(sum(s) * 0.05::DOUBLE)::BIGINT))::BIGINT AS required_bytes
    FROM (SELECT strlen(text) AS s FROM documents)"""


@query(SPACE_SQL.format(copy="sum(s)"))
def preflight_bytes(spark, sf):
    return reports.space_needed(fingerprint_docs(spark, sf), 100, True)


@query(SPACE_SQL.format(copy="(SELECT sum(s) FROM (SELECT strlen(text) AS s FROM documents ORDER BY s DESC LIMIT 100))"))
def preflight_topk(spark, sf):
    return reports.space_needed(fingerprint_docs(spark, sf), 100, False)


def _cache(spark, sf):
    return documents_bare(spark, sf).where("doc_id % 2 = 0").select("path", "fingerprint", F.lit("v1").alias("analyzer"), "doc_id", F.lit(0).alias("written"))


def documents_bare(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.sha2("text", 256).alias("fingerprint"))


WORK_SQL = "work AS (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(text) AS fingerprint FROM documents)"


@query(f"WITH {WORK_SQL} SELECT w.path, w.fingerprint, c.doc_id AS cached_doc FROM work w JOIN work c ON w.fingerprint = c.fingerprint AND c.doc_id % 2 = 0")
def cache_hits(spark, sf):
    return cache.hits(documents_bare(spark, sf), _cache(spark, sf), "v1").select("path", "fingerprint", F.col("doc_id").alias("cached_doc"))


@query(f"WITH {WORK_SQL} SELECT fingerprint, min(path) AS path FROM work WHERE fingerprint NOT IN (SELECT fingerprint FROM work WHERE doc_id % 2 = 0) GROUP BY fingerprint")
def cache_misses(spark, sf):
    return cache.misses(documents_bare(spark, sf), _cache(spark, sf), "v1")


@query(f"""WITH {WORK_SQL}, both_ AS (SELECT fingerprint, doc_id, 0 AS gen FROM work WHERE doc_id % 2 = 0 UNION ALL SELECT fingerprint, doc_id, 1 FROM work WHERE doc_id % 3 = 0)
    SELECT fingerprint, max_by(doc_id, gen * 1000000000 + doc_id) AS doc_id, max(gen)::INT AS gen FROM both_ GROUP BY fingerprint""")
def cache_upsert(spark, sf):
    rows = documents_bare(spark, sf).select("fingerprint", F.lit("v1").alias("analyzer"), "doc_id", F.col("doc_id").alias("written"))
    old, new = rows.where("doc_id % 2 = 0").withColumn("gen", F.lit(0)), rows.where("doc_id % 3 = 0").withColumn("gen", F.lit(1))
    return cache.upserted(old, new).select("fingerprint", "doc_id", "gen")


@query("""WITH e AS (SELECT 'h' || (page_id % 90) AS name, md5(url) AS checksum FROM pages WHERE page_id < 80), a AS (SELECT 'h' || (page_id % 90) AS name, md5(url || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END) AS checksum FROM pages WHERE page_id BETWEEN 10 AND 89)
    SELECT * FROM (SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN e.checksum <> a.checksum THEN 'different' END AS state FROM e FULL JOIN a ON e.name = a.name) WHERE state IS NOT NULL""")
def checksum_verify(spark, sf):
    p = table(spark, sf, "pages").withColumn("name", F.concat(F.lit("h"), (F.col("page_id") % 90).cast("string")))
    expected = p.where("page_id < 80").select("name", F.md5("url").alias("checksum"))
    actual = p.where("page_id between 10 and 89").select("name", F.md5(F.concat("url", F.when(F.col("page_id") % 5 == 0, "x").otherwise(""))).alias("checksum"))
    return reports.checksum_mismatches(expected, actual)


WHOLE_UPSERT_SQL = """both_ AS (SELECT fingerprint, doc_id, 0 AS gen FROM work UNION ALL SELECT fingerprint, doc_id, 1 FROM work)
    SELECT fingerprint, max_by(doc_id, gen * 1000000000000 + doc_id) AS doc_id, max(gen)::INT AS gen FROM both_ GROUP BY fingerprint"""


@query(f"WITH {WORK_SQL}, {WHOLE_UPSERT_SQL}")
def cache_upsert_whole(spark, sf):
    rows = documents_bare(spark, sf).select("fingerprint", F.lit("v1").alias("analyzer"), "doc_id", F.col("doc_id").alias("written"))
    return cache.upserted(rows.withColumn("gen", F.lit(0)), rows.withColumn("gen", F.lit(1))).select("fingerprint", "doc_id", "gen")


@query("""WITH p AS (SELECT 'h' || page_id AS name, url, md5(page_id::VARCHAR) AS h FROM pages),
    e AS (SELECT name, md5(url) AS checksum FROM p WHERE substr(h, 1, 1) <> '0'), a AS (SELECT name, md5(url || CASE WHEN substr(h, 3, 1) < '3' THEN 'x' ELSE '' END) AS checksum FROM p WHERE substr(h, 2, 1) <> '0')
    SELECT * FROM (SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN e.checksum <> a.checksum THEN 'different' END AS state FROM e FULL JOIN a ON e.name = a.name) WHERE state IS NOT NULL""")
def checksum_verify_whole(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("name"), "url", F.md5(F.col("page_id").cast("string")).alias("h"))
    expected = p.where("substr(h, 1, 1) <> '0'").select("name", F.md5("url").alias("checksum"))
    actual = p.where("substr(h, 2, 1) <> '0'").select("name", F.md5(F.concat("url", F.when(F.expr("substr(h, 3, 1) < '3'"), "x").otherwise(""))).alias("checksum"))
    return reports.checksum_mismatches(expected, actual)


@query(f"""WITH {WORK_SQL}, d AS (SELECT *, 'f' || (doc_id % 40) || '.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN 'selected' ELSE 'rejected' END AS category FROM work),
    n AS (SELECT *, CASE WHEN category = 'selected' THEN lpad(doc_id::VARCHAR, 4, '0') || '_' || name ELSE name END AS plain FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY category, plain ORDER BY doc_id) AS nth FROM n)
    SELECT doc_id, category || '/' || CASE WHEN nth = 1 THEN plain ELSE substr(fingerprint, 1, 8) || '_' || nth || '_' || name END AS destination FROM k""")
def destination_plan(spark, sf):
    d = documents_bare(spark, sf)
    rows = d.select(F.concat(F.col("path"), F.lit("/f"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")).alias("path"), "fingerprint", F.when(F.col("doc_id") % 3 == 0, "selected").otherwise("rejected").alias("category"), F.col("doc_id").alias("item_index"))
    rows = rows.withColumn("item_index", F.col("item_index"))
    planned = reports.destinations(rows)
    return planned.join(rows.select("path", F.col("item_index").alias("doc_id")), "path").select("doc_id", "destination")


def _states(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.when(F.col("event_id") % 11 == 0, "complete").otherwise("running")
    return e.select(
        F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.col("event_id").alias("written"), kinds.alias("status"), F.col("event_type").alias("stage"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), F.lit("{}").alias("config"), F.lit("v1").alias("analyzer"))


STATES_SQL = """states AS (SELECT 'run' || (user_id % 50) AS run_id, event_id AS written, CASE WHEN event_id % 11 = 0 THEN 'complete' ELSE 'running' END AS status, event_type AS stage, 'src' || (user_id % 5) AS source FROM events),
    latest AS (SELECT run_id, max(written) AS written, max_by(status, written) AS status, max_by(stage, written) AS stage, max_by(source, written) AS source FROM states GROUP BY run_id)"""


@query(f"WITH {STATES_SQL} SELECT * FROM latest")
def journal_latest(spark, sf):
    return journal.latest(_states(spark, sf).drop("config", "analyzer"))


@query(f"WITH {STATES_SQL} SELECT run_id, written, stage FROM latest WHERE status <> 'complete' AND source = 'src3' ORDER BY written DESC, run_id DESC LIMIT 1")
def resume_candidate(spark, sf):
    return journal.resumable(_states(spark, sf), "src3", "{}", "v1").select("run_id", "written", "stage")


# hashes and duplicates


@query(f"""WITH {WORK_SQL}, d AS (SELECT *, (doc_id * 37 % 101)::DOUBLE / 100.0::DOUBLE AS quality FROM work)
    SELECT path, first_value(path) OVER (PARTITION BY fingerprint ORDER BY quality DESC, path) AS keep_path, count(*) OVER (PARTITION BY fingerprint) AS copies FROM d""")
def exact_duplicates(spark, sf):
    d = documents_bare(spark, sf).withColumn("quality", (F.col("doc_id") * 37 % 101) / 100.0)
    return duplicates.exact(d).select("path", "keep_path", "copies")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_reduce(v, lambda a, b: a + b) / 64 AS mean FROM e),
    b AS (SELECT vec_id, i, CASE WHEN x >= mean THEN 1 ELSE 0 END AS bit FROM (SELECT vec_id, mean, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m))
    SELECT vec_id, lower(printf('%08x%08x', sum(CASE WHEN i <= 32 THEN bit::BIGINT << (32 - i) ELSE 0 END)::BIGINT, sum(CASE WHEN i > 32 THEN bit::BIGINT << (64 - i) ELSE 0 END)::BIGINT)) AS hash FROM b GROUP BY vec_id""")
def avg_hash_vec(spark, sf):
    return tiles(spark, sf)


@query(f"WITH {DOCS_SQL} SELECT doc_id, hash FROM docs")
def word_hashes(spark, sf):
    return documents(spark, sf).select("doc_id", "hash")


def _block_sql(radius: int) -> str:
    parts = []
    for i, (at, w) in enumerate(block_bounds(radius)):
        parts.append(f"SELECT doc_id, {i}::INT AS block, (((hi::HUGEINT * 4294967296 + lo) >> {at}) % {1 << w})::VARCHAR AS key FROM docs")
    return f"WITH {DOCS_SQL} " + " UNION ALL ".join(parts)


@query(_block_sql(8))
def block_index(spark, sf):
    return documents(spark, sf).select("doc_id", F.inline(block_keys(F.col("hash"), 8)))


CLASSES_SQL = "classes AS MATERIALIZED (SELECT hash, any_value(hi) AS hi, any_value(lo) AS lo, min(doc_id) AS class_id FROM docs GROUP BY hash)"


@query(f"WITH {DOCS_SQL}, {CLASSES_SQL} SELECT doc_id, docs.hash, class_id FROM docs JOIN classes ON docs.hash = classes.hash")
def hash_classes(spark, sf):
    return duplicates.hash_classes(documents(spark, sf), "doc_id")


def _pairs_sql(radius: int) -> str:
    return f"""WITH {DOCS_SQL}, {CLASSES_SQL} SELECT a.class_id AS left_id, b.class_id AS right_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance
        FROM classes a JOIN classes b ON a.class_id < b.class_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {radius}"""


for _r in (8, 4):
    query(_pairs_sql(_r), f"hamming_pairs_r{_r}")(lambda spark, sf, r=_r: duplicates.hamming_pairs(documents(spark, sf), "doc_id", r))


def _near_ctes(radius: int | None, rounds: int = 10, docs: str = "docs") -> list[str]:
    """Tables up to ``owned`` (path, rep, head): brute-force pairs of ``docs``, then as many rounds of the independent set as any chain here needs."""
    close = "false" if radius is None else f"bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {radius}"
    ctes = [f"edges AS MATERIALIZED (SELECT a.path AS u, b.path AS v FROM {docs} a JOIN {docs} b ON (a.quality > b.quality OR a.quality = b.quality AND a.path < b.path) AND (a.fingerprint = b.fingerprint OR {close}))",
            "open0 AS (SELECT * FROM edges)"]
    for k in range(rounds):
        ctes.append(f"heads{k} AS MATERIALIZED (SELECT DISTINCT u FROM open{k} WHERE u NOT IN (SELECT v FROM open{k}))")
        ctes.append(f"gone{k} AS MATERIALIZED (SELECT DISTINCT v FROM open{k} WHERE u IN (SELECT u FROM heads{k}))")
        ctes.append(f"open{k + 1} AS MATERIALIZED (SELECT * FROM open{k} WHERE u NOT IN (SELECT u FROM heads{k}) AND u NOT IN (SELECT v FROM gone{k}) AND v NOT IN (SELECT v FROM gone{k}))")
    gone = " UNION ALL ".join(f"SELECT v FROM gone{k}" for k in range(rounds))
    ctes.append(f"gone AS MATERIALIZED ({gone})")
    ctes.append(f"rep AS (SELECT e.v AS path, first(e.u ORDER BY d.quality DESC, d.path) AS rep FROM edges e JOIN {docs} d ON d.path = e.u WHERE e.v IN (SELECT v FROM gone) AND e.u NOT IN (SELECT v FROM gone) GROUP BY e.v)")
    ctes.append(f"owned AS (SELECT d.path, rep, coalesce(rep, d.path) AS head FROM {docs} d LEFT JOIN rep ON d.path = rep.path)")
    ctes.append(f"near_groups AS MATERIALIZED (SELECT o.path, o.rep AS duplicate_of, CASE WHEN count(*) OVER (PARTITION BY head) > 1 THEN h.fingerprint END AS group_id FROM owned o JOIN {docs} h ON h.path = o.head)")
    return ctes


def _near_sql(radius: int | None, rounds: int = 10) -> str:
    return f"WITH {', '.join([DOCS_SQL, *_near_ctes(radius, rounds)])} SELECT path, duplicate_of, group_id FROM near_groups"


for _name, _radius in (("strong", 8), ("normal", 4), ("exact", None)):
    query(_near_sql(_radius), f"near_dedup_{_name}")(lambda spark, sf, r=_radius: duplicates.near(documents(spark, sf), r))


def _grouped(spark, sf):
    category = F.when(F.col("duplicate_of").isNull(), "selected").otherwise("rejected")
    return duplicates.judged(documents(spark, sf), 8).select("path", "quality", F.col("group_id").alias("duplicate_group"), category.alias("category"))


@query(f"""WITH grouped AS ({_near_sql(8)}), named AS (SELECT g.*, (right(path, 8)::BIGINT) AS doc_id FROM grouped g)
    SELECT path, CASE WHEN duplicate_of IS NULL THEN 'selected' ELSE 'rejected' END AS category FROM named
    WHERE group_id = (SELECT group_id FROM named WHERE group_id IS NOT NULL ORDER BY path LIMIT 1) AND path <> (SELECT path FROM named WHERE group_id IS NOT NULL ORDER BY path LIMIT 1)""")
def duplicate_peers(spark, sf):
    from ..sources.store import Tables

    grouped = Tables(spark, "peers").save(_grouped(spark, sf), "grouped")
    first = grouped.where("duplicate_group is not null").agg(F.min("path")).first()[0]
    return duplicates.peers(grouped, first).select("path", "category")


# matching


@query(f"WITH {REFS_SQL}, {TARGET_SQL}, k AS (SELECT unnest(c) AS x, generate_subscripts(c, 1)::INT - 1 AS i, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS n FROM target) SELECT i, round(x / n, 6) AS x FROM k")
def centroid_refs(spark, sf):
    return centroid(references(spark, sf), "vec").select(F.posexplode("centroid").alias("i", "x")).select("i", F.round("x", 6).alias("x"))


@query(f"WITH {MATCHED_SQL} SELECT vec_id, match FROM matched")
def identity_scores(spark, sf):
    return matching.scored(items(spark, sf), references(spark, sf)).select("vec_id", "match")


@query(f"""WITH {MATCHED_SQL} SELECT count(*) AS scored, count_if(match >= 0.55) AS passed, round(min(match), 6) AS minimum, round(median(match), 6) AS median, round(max(match), 6) AS maximum,
    count_if(match < 0.5) AS below_50, count_if(match >= 0.5 AND match < 0.6) AS from_50, count_if(match >= 0.6 AND match < 0.7) AS from_60, count_if(match >= 0.7 AND match < 0.8) AS from_70, count_if(match >= 0.8) AS from_80
    FROM matched WHERE subjects > 0""")
def identity_stats(spark, sf):
    return matching.statistics(matching.scored(items(spark, sf), references(spark, sf)), 0.55)


PAIRS_SQL = f"{REFS_SQL}, pairs AS (SELECT a.vec_id AS left_ref, b.vec_id AS right_ref, round(least(greatest((list_cosine_similarity(a.vec, b.vec) + 1) / 2, 0), 1), 6)::DOUBLE AS score FROM refs a JOIN refs b ON a.vec_id < b.vec_id)"


@query(f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def reference_pairs(spark, sf):
    return matching.reference_pairs(references(spark, sf), "vec_id")


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT count(*) AS pairs, min(score) AS lowest, round(avg(score), 6) AS average, first(left_ref ORDER BY score, left_ref, right_ref) AS lowest_left, first(right_ref ORDER BY score, left_ref, right_ref) AS lowest_right FROM pairs), r AS (SELECT count(*) AS refs FROM refs)
    SELECT refs, pairs, lowest, average, lowest_left, lowest_right, CASE WHEN refs = 1 THEN 'few_references' WHEN lowest < 0.65 THEN 'inconsistent' WHEN refs > 5 THEN 'many_references' END AS warning FROM r, s""")
def reference_warning(spark, sf):
    return matching.reference_summary(references(spark, sf), "vec_id")


GATED_SQL = f"""{MATCHED_SQL}, gated AS (
    SELECT *, CASE WHEN invalid OR subjects = 0 THEN 'INVALID' WHEN subjects > 1 THEN 'MULTI_SUBJECT' WHEN match < 0.55 THEN 'LOW_MATCH' WHEN quality < 0.30 THEN 'LOW_QUALITY' END AS reason_code FROM matched)"""


def _gated(spark, sf):
    return gates.gated(matching.scored(items(spark, sf), references(spark, sf)), LIMITS)


@query(f"WITH {GATED_SQL} SELECT vec_id, reason_code FROM gated", "gates")
def gates_query(spark, sf):
    return _gated(spark, sf).select("vec_id", "reason_code")


@query(f"WITH {GATED_SQL} SELECT coalesce(reason_code, 'PASS') AS category, count(*) AS items FROM gated GROUP BY 1")
def gate_counts(spark, sf):
    return reports.category_counts(_gated(spark, sf).withColumn("category", F.coalesce("reason_code", F.lit("PASS"))))


# clusters


@query(f"WITH {ITEMS_SQL} SELECT vec_id, CASE WHEN yaw <= -35 THEN 'left_profile' WHEN yaw <= -12 THEN 'left_turn' WHEN yaw >= 35 THEN 'right_profile' WHEN yaw >= 12 THEN 'right_turn' ELSE 'frontal' END AS bucket FROM items")
def pose_bucket(spark, sf):
    return items(spark, sf).select("vec_id", S.coarse_pose(F.col("yaw")).alias("bucket"))


@query(f"WITH {ITEMS_SQL} SELECT vec_id, 'pose_' || lpad(floor((greatest(least(yaw, 90), -90) + 90) / 15)::INT::VARCHAR, 2, '0') || '_' || lpad(floor((greatest(least(pitch, 60), -60) + 60) / 15)::INT::VARCHAR, 2, '0') AS cell FROM items")
def pose_cluster(spark, sf):
    return items(spark, sf).select("vec_id", S.pose_cell(F.col("yaw"), F.col("pitch")).alias("cell"))


_MEAN_SQL = "list_reduce({x}, lambda a, b: a + b) / len({x})"
SIGNATURE_SQL = "{name} AS (SELECT vec_id, lower(printf('%02x', (" + " + ".join(
    f"CASE WHEN {_MEAN_SQL.format(x=f'list_filter({{v}}, lambda x, i: (i - 1) % 6 = {b})')} >= {_MEAN_SQL.format(x='{v}')} THEN {1 << b} ELSE 0 END" for b in range(6)) + ")::BIGINT)) AS sig FROM items)"
_SCENE, _APPEARANCE = "vec[1:32]", "vec[33:64]"


def _clustered(spark, sf):
    i = items(spark, sf).withColumns({"scene_vec": F.slice("vec", 1, 32), "appearance_vec": F.slice("vec", 33, 32)})
    return clusters.clustered(i)


@query(f"WITH {ITEMS_SQL}, {SIGNATURE_SQL.format(name='s', v=_SCENE)}, {SIGNATURE_SQL.format(name='a', v=_APPEARANCE)} SELECT vec_id, 'scene_' || s.sig AS scene, 'appearance_' || a.sig AS appearance FROM s JOIN a USING (vec_id)")
def cluster_signature(spark, sf):
    return _clustered(spark, sf).select("vec_id", "scene", "appearance")


CLUSTER_SQL = f"""{GATED_SQL}, {SIGNATURE_SQL.format(name='s', v=_SCENE)}, {SIGNATURE_SQL.format(name='a', v=_APPEARANCE)},
    clustered AS (
        SELECT gated.*, 'pose_' || lpad(floor((yaw + 90) / 15)::INT::VARCHAR, 2, '0') || '_' || lpad(floor((pitch + 60) / 15)::INT::VARCHAR, 2, '0') AS pose,
               'scene_' || s.sig AS scene, 'appearance_' || a.sig AS appearance, 'set' || (vec_id % 7) || '|scene_' || s.sig || '|appearance_' || a.sig AS session
        FROM gated JOIN s USING (vec_id) JOIN a USING (vec_id))"""


@query(f"WITH {CLUSTER_SQL} SELECT vec_id, session FROM clustered")
def session_cluster(spark, sf):
    return _clustered(spark, sf).select("vec_id", "session")


# selection


def _candidates(spark, sf):
    gated = gates.gated(matching.scored(_clustered(spark, sf), references(spark, sf)), LIMITS)
    return gated.where("reason_code is null").withColumn("vec", F.col("visual_vec"))


def _pick_ctes(profile: str, picks: int, forced: tuple[str, ...] = ()) -> list[str]:
    """The greedy rule over ``cand``, each pick a query over all candidates and the picks before it; ``forced``: queries of paths."""
    w = [f"{x}::DOUBLE" for x in PROFILES[profile]]
    ctes = ["chosen0 AS (SELECT path, vec, pose, expression, appearance, scene, session, 0 AS pick, 0::DOUBLE AS value FROM cand WHERE false)"]
    for k in range(picks):
        nov = [f"1.0::DOUBLE / (1 + (SELECT count(*) FROM chosen{k} h WHERE h.{b} = c.{b}))" for b in ("pose", "expression", "appearance", "scene", "session")]
        near = f"coalesce((SELECT max(floor(list_cosine_similarity(h.vec, c.vec) * 1e6 + 0.5) / 1e6) FROM chosen{k} h), 0)"
        terms = ["c.quality", "c.match", f"(1 - greatest(0, {near}))", *nov]
        value = " + ".join(f"{a} * {t}" for a, t in zip(w, terms))
        only = f"c.path = ({forced[k]})" if k < len(forced) else f"c.path NOT IN (SELECT path FROM chosen{k})"
        ctes.append(f"pick{k} AS MATERIALIZED (SELECT path, vec, pose, expression, appearance, scene, session, {k + 1} AS pick, ({value})::DOUBLE AS value FROM cand c WHERE {only} ORDER BY value DESC, path LIMIT 1)")
        ctes.append(f"chosen{k + 1} AS MATERIALIZED (SELECT * FROM chosen{k} UNION ALL SELECT * FROM pick{k})")
    return ctes


def _select_sql(profile: str, picks: int, forced: tuple[str, ...] = (), where: str = "reason_code IS NULL") -> str:
    ctes = [CLUSTER_SQL, f"cand AS MATERIALIZED (SELECT * FROM clustered WHERE {where})", *_pick_ctes(profile, picks, forced)]
    return f"WITH {', '.join(ctes)} SELECT path, pick::INT AS pick, round(value * 100, 3) AS value FROM chosen{picks}"


for _profile in PROFILES:
    query(_select_sql(_profile, 8), f"select_{_profile}")(
        lambda spark, sf, p=_profile: selection.select(_candidates(spark, sf), Choice(8, PROFILES[p])).select("path", "pick", "value"))


@query(_select_sql("balanced", 8, ("SELECT path FROM cand ORDER BY quality, path LIMIT 1", "SELECT path FROM cand ORDER BY quality, path LIMIT 1 OFFSET 1")))
def select_forced(spark, sf):
    """The two candidates with the lowest quality are put in first."""
    cand = _candidates(spark, sf)
    forced = [r.path for r in cand.orderBy("quality", "path").limit(2).collect()]
    return selection.select(cand, EIGHT, forced).select("path", "pick", "value")


def _decided(spark, sf):
    from ..sources.store import Tables

    tables = Tables(spark, "decided")
    gated = tables.save(gates.gated(matching.scored(_clustered(spark, sf), references(spark, sf)), LIMITS), "gated")
    picks = selection.select(gated.where("reason_code is null").withColumn("vec", F.col("visual_vec")), EIGHT)
    return tables.save(selection.decided(gated, picks).withColumn("forced", F.lit(False)), "decided")


DECIDED_SQL = f"""picked AS ({_select_sql('balanced', 8)}), decided AS (
    SELECT g.vec_id, g.path, g.match, g.quality, p.pick, p.value, CASE WHEN p.pick IS NOT NULL THEN 'selected' ELSE 'rejected' END AS decision, CASE WHEN p.pick IS NOT NULL THEN NULL ELSE coalesce(g.reason_code, 'REDUNDANT') END AS reason_code
    FROM (WITH {GATED_SQL} SELECT * FROM gated) g LEFT JOIN picked p USING (path))"""


@query(f"WITH {DECIDED_SQL} SELECT decision, reason_code, count(*) AS items FROM decided GROUP BY ALL")
def selection_summary(spark, sf):
    return _decided(spark, sf).groupBy("decision", "reason_code").agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH {DECIDED_SQL} SELECT path, reason_code FROM decided WHERE decision = 'rejected' AND match >= 0.5 AND quality >= 0.4")
def review_filter(spark, sf):
    return review.filtered(_decided(spark, sf), "rejected", 0.5, 0.4).select("path", "reason_code")


WHY_SQL = """CASE WHEN decision = 'selected' THEN printf('pick %d, value %.3f', pick, value) WHEN reason_code = 'DUPLICATE' THEN 'copy of ' || duplicate_of
    WHEN reason_code = 'LOW_MATCH' THEN printf('match %.3f', match) WHEN reason_code = 'LOW_QUALITY' THEN printf('quality %.3f', quality) ELSE lower(replace(reason_code, '_', ' ')) END"""


@query(f"WITH {DECIDED_SQL} SELECT path, {WHY_SQL} AS why FROM (SELECT *, NULL::VARCHAR AS duplicate_of FROM decided)")
def why_rejected(spark, sf):
    said = curation.reasons(_decided(spark, sf).withColumn("duplicate_of", F.lit(None).cast("string")))
    return review.explained(said).select("path", "why")


@query(f"""WITH before_ AS MATERIALIZED ({_select_sql('balanced', 8)}), pool AS MATERIALIZED (WITH {CLUSTER_SQL} SELECT path, quality FROM clustered WHERE reason_code IS NULL),
    out_ AS MATERIALIZED (SELECT path FROM before_ WHERE pick = 1), new_ AS MATERIALIZED (SELECT path FROM pool WHERE path NOT IN (SELECT path FROM before_) ORDER BY quality DESC, path LIMIT 1),
    after_ AS MATERIALIZED ({_select_sql('balanced', 8, ('SELECT path FROM new_',), 'reason_code IS NULL AND path NOT IN (SELECT path FROM out_)')})
    SELECT path, 'added' AS change FROM after_ WHERE path NOT IN (SELECT path FROM before_) UNION ALL SELECT path, 'removed' FROM before_ WHERE path NOT IN (SELECT path FROM after_)""")
def review_diff(spark, sf):
    """The first pick is taken out and the best left-over is put in; the rest is chosen anew."""
    rows = _decided(spark, sf)
    out = rows.where("pick = 1").first().path
    new = rows.where("reason_code = 'REDUNDANT'").orderBy(F.desc("quality"), "path").first().path
    edited = review.edited(rows.withColumn("vec", F.col("visual_vec")), EIGHT, include=new, exclude=out)
    return review.difference(edited)


def _greedy_sql(profile: str, picks: int) -> str:
    """chosen (path, pick, value): the greedy rule over ``cand`` by recursion, each step one pick and every candidate's state after it."""
    w = [f"{x}::DOUBLE" for x in PROFILES[profile]]
    buckets = ("pose", "expression", "appearance", "scene", "session")
    value = " + ".join(f"{a} * {t}" for a, t in zip(w, ("quality", "match", "(1 - near)", *[f"1.0::DOUBLE / (1 + n_{b})" for b in buckets])))
    names = ", ".join(buckets)
    return f"""greedy AS (
        SELECT path, vec, quality, match, {names}, 0 AS step, 0::DOUBLE AS near, {', '.join(f'0 AS n_{b}' for b in buckets)}, NULL::INT AS pick, NULL::DOUBLE AS value FROM cand
        UNION ALL
        SELECT path, vec, quality, match, {names}, step + 1, greatest(near, floor(list_cosine_similarity(best.vec, vec) * 1e6 + 0.5) / 1e6), {', '.join(f'n_{b} + (best.{b} = {b})::INT' for b in buckets)},
               CASE WHEN path = best.path THEN step + 1 ELSE pick END, CASE WHEN path = best.path THEN now ELSE value END
        FROM (SELECT *, first_value({{'path': path, 'vec': vec, 'pick': pick, {', '.join(f"'{b}': {b}" for b in buckets)}}}) OVER (ORDER BY pick IS NOT NULL, now DESC, path) AS best FROM (SELECT *, ({value})::DOUBLE AS now FROM greedy))
        WHERE step < {picks} AND best.pick IS NULL),
    chosen AS (SELECT path, pick, value FROM greedy WHERE step = (SELECT max(step) FROM greedy) AND pick IS NOT NULL)"""


CURATED_SQL = f"""WITH RECURSIVE {CLUSTER_SQL},
    hashed AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reduce(embedding::DOUBLE[], lambda a, b: a + b) / 64 AS mean FROM embeddings),
    bits AS (SELECT vec_id, i, CASE WHEN x >= mean THEN 1 ELSE 0 END AS bit FROM (SELECT vec_id, mean, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM hashed)),
    tile AS (SELECT vec_id, sum(CASE WHEN i <= 32 THEN bit::BIGINT << (32 - i) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN i > 32 THEN bit::BIGINT << (64 - i) ELSE 0 END)::BIGINT AS lo FROM bits GROUP BY vec_id),
    passed AS MATERIALIZED (SELECT c.path, c.fingerprint, c.quality, hi, lo FROM clustered c JOIN tile USING (vec_id) WHERE reason_code IS NULL),
    {', '.join(_near_ctes(8, docs='passed'))},
    flagged AS MATERIALIZED (SELECT c.* EXCLUDE (reason_code), coalesce(c.reason_code, CASE WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE' END) AS reason_code, duplicate_of, group_id FROM clustered c LEFT JOIN near_groups n ON n.path = c.path),
    cand AS MATERIALIZED (SELECT * FROM flagged WHERE reason_code IS NULL), {_greedy_sql('balanced', 100)},
    final AS (SELECT f.path, f.match, f.quality, p.pick, round(p.value * 100, 3) AS value, duplicate_of, group_id, CASE WHEN p.pick IS NULL THEN 'rejected' ELSE 'selected' END AS decision,
                     CASE WHEN p.pick IS NULL THEN coalesce(f.reason_code, 'REDUNDANT') END AS reason_code FROM flagged f LEFT JOIN chosen p ON p.path = f.path)
    SELECT path, decision, reason_code, pick::INT AS pick, value, group_id AS duplicate_group, {WHY_SQL} AS reasons FROM final"""


@query(CURATED_SQL)
def curated(spark, sf):
    """The whole flow over the embeddings, with the default hundred picks."""
    i = items(spark, sf).join(tiles(spark, sf), "vec_id").withColumns({"scene_vec": F.slice("vec", 1, 32), "appearance_vec": F.slice("vec", 33, 32)})
    said = curation.reasons(curation.curate(i, references(spark, sf), FULL_POLICY))
    return said.select("path", "decision", "reason_code", "pick", "value", "duplicate_group", F.array_join("reasons", "; ").alias("reasons"))


# calibration and scalar rules


@query("""WITH s AS (SELECT (least(n_chars, 4000)::DOUBLE / 4000.0::DOUBLE) AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id)),
    v AS (SELECT DISTINCT least(greatest(score, 0), 1) AS v FROM s), t AS (SELECT 0::DOUBLE AS t UNION SELECT 1 UNION SELECT (v + lead(v) OVER (ORDER BY v)) / 2 FROM v),
    c AS (SELECT t, count_if(score >= t AND label) AS tp, count_if(score < t AND NOT label) AS tn, count_if(score >= t AND NOT label) AS fp, count_if(score < t AND label) AS fn FROM s, t WHERE t IS NOT NULL GROUP BY t),
    m AS (SELECT *, tp::DOUBLE / greatest(1, tp + fn) AS recall, tp::DOUBLE / greatest(1, tp + fp) AS precision, (tp::DOUBLE / greatest(1, tp + fn) + tn::DOUBLE / greatest(1, tn + fp)) / 2 AS ba FROM c)
    SELECT round(t, 6) AS threshold, round(ba, 6) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp + tn + fp + fn AS samples
    FROM m ORDER BY ba DESC, m.precision DESC, m.recall DESC, t LIMIT 1""")
def calibrate_quality(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return calibration.best_threshold(d.select((F.least(F.col("n_chars"), F.lit(4000)).cast("double") / 4000.0).alias("score"), (F.col("quality") == 1).alias("label")))


@query("""SELECT doc_id, lower(trim(w)) IN ('1', 'true', 'yes', 'y', 'positive', 'same', 'accept') AS label
    FROM (SELECT doc_id, ([' Yes', 'NO ', '1', '0', 'Same', 'different', 'ACCEPT', 'reject', 'true', 'False'])[(doc_id % 10 + 1)::INT] AS w FROM labels)""")
def label_parse(spark, sf):
    words = F.array(*map(F.lit, (" Yes", "NO ", "1", "0", "Same", "different", "ACCEPT", "reject", "true", "False")))
    return table(spark, sf, "labels").select("doc_id", S.parse_label(F.element_at(words, (F.col("doc_id") % 10 + 1).cast("int"))).alias("label"))


@query("SELECT o_orderkey, (CASE WHEN m / 1024 < 8 THEN 2 WHEN m / 1024 < 12 THEN 4 WHEN m / 1024 < 20 THEN 8 ELSE 12 END)::INT AS batch FROM (SELECT o_orderkey, o_totalprice / 15 AS m FROM orders)")
def batch_size_tier(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.batch_size(F.col("o_totalprice") / 15).alias("batch"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS duration
    FROM (SELECT event_id, (event_id * 7 % 9000)::BIGINT AS s FROM events)""")
def duration_text(spark, sf):
    return table(spark, sf, "events").select("event_id", S.duration_text(F.col("event_id") * 7 % 9000).alias("duration"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def keyword_search_all(spark, sf):
    return table(spark, sf, "documents").where(S.contains_all(F.lit(" The  OF "), F.col("text"))).select("doc_id")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'download' WHEN event_id % 4 = 1 THEN 'accelerator' WHEN event_id % 4 = 2 THEN 'reference' WHEN event_id % 4 = 3 THEN 'space' ELSE 'other' END AS failure FROM events""")
def failure_triage(spark, sf):
    e = table(spark, sf, "events")
    message = F.when(F.col("event_type").isin("click", "view"), "Download of CUDA files broke off").when(F.col("event_id") % 4 == 1, "CUDNN is missing").when(F.col("event_id") % 4 == 2, "No Reference").when(F.col("event_id") % 4 == 3, "Not enough room").otherwise("odd")
    return e.select("event_id", S.failure_class(message).alias("failure"))


@query("SELECT event_id, event_id % 3 <> 0 AS good, CASE WHEN event_id % 3 <> 0 THEN (event_id % 100)::INT END AS load FROM events")
def telemetry_parse(spark, sf):
    line = F.concat_ws(", ", (F.col("event_id") % 100).cast("string"), F.lit("512"), F.when(F.col("event_id") % 3 != 0, F.lit("16384")), F.lit("61.0"))
    m = S.accelerator_metrics(line)
    return table(spark, sf, "events").select("event_id", m.isNotNull().alias("good"), m["load"].alias("load"))


@query("""SELECT doc_id, 'm-1-cpu-x-' || substr(sha256(sha256(text) || sha256(lang)), 1, 12) AS version FROM documents""")
def analyzer_versions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.analyzer_key(F.lit("m"), F.lit("1"), F.lit("cpu"), F.lit("x"), F.array(F.sha2("text", 256), F.sha2("lang", 256))).alias("version"))


@query("""WITH w AS (SELECT doc_id, sha256(text) AS f FROM documents) SELECT doc_id, round(list_sum(list_transform(range(16), lambda i: ('0x' || substr(f, 2 * i + 1, 2))::INT / 255.0::DOUBLE)), 6) AS total FROM w""")
def digest_vectors(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(F.aggregate(S.digest_vector(F.sha2("text", 256)), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH {ITEMS_SQL}, q AS (SELECT vec_id, abs(vec[1]) AS a, abs(vec[2]) AS b, abs(vec[3]) AS c, abs(vec[4]) AS d FROM items),
    k AS (SELECT vec_id, least(a * 5000 / 1800, 1) AS sharp, least(greatest(0.55::DOUBLE * b + 0.30::DOUBLE * least(greatest((c * 400 - d * 100) / 170, 0), 1) + 0.15::DOUBLE * (1 - d), 0), 1) AS exposed,
          1 - least(greatest(0.45::DOUBLE * a + 0.30::DOUBLE * b + 0.25::DOUBLE * c, 0), 1) AS hidden, d AS artifact, c AS share, b AS detection FROM q)
    SELECT vec_id, round(0.27::DOUBLE * sharp + 0.18::DOUBLE * exposed + 0.16::DOUBLE * least(1, 3 * sqrt(share)) + 0.12::DOUBLE * detection + 0.14::DOUBLE * (1 - hidden) + 0.13::DOUBLE * (1 - artifact), 6) AS quality,
           round(0.45::DOUBLE * sharp + 0.30::DOUBLE * exposed + 0.25::DOUBLE * least(1, sqrt(vec_id::DOUBLE * 600) / 1600), 6) AS baseline,
           (CASE WHEN sharp < 0.25 THEN 'soft,' ELSE '' END || CASE WHEN exposed < 0.35 THEN 'badly_exposed,' ELSE '' END || CASE WHEN hidden > 0.35 THEN 'hidden,' ELSE '' END || CASE WHEN artifact > 0.35 THEN 'blocky,' ELSE '' END) AS flags
    FROM k""")
def quality_composite(spark, sf):
    v = lambda i: F.abs(F.element_at("vec", i))
    q = items(spark, sf).select("vec_id", *[v(i + 1).alias(n) for i, n in enumerate("abcd")])
    sharp, hidden = S.sharpness(F.col("a") * 5000), S.occlusion(F.col("a"), F.col("b"), F.col("c"))
    exposed = S.exposure(F.col("b"), F.col("d") * 100, F.col("c") * 400, F.col("d"))
    return q.select(
        "vec_id", F.round(S.subject_quality(sharp, exposed, F.col("c"), F.col("b"), hidden, F.col("d")), 6).alias("quality"), F.round(S.baseline_quality(sharp, exposed, F.col("vec_id").cast("double"), F.lit(600)), 6).alias("baseline"),
        F.array_join(F.transform(S.diagnostic_flags(sharp, exposed, hidden, F.col("d")), lambda x: F.concat(x, F.lit(","))), "").alias("flags"))


def _face(opening: float, eye: float, mouth: float, lift: float) -> list[list[float]]:
    """Landmarks of a face in a box of 100 x 100 with these proportions; points that no rule reads are 0."""
    p = [[0.0, 0.0] for _ in range(68)]
    for i in (36, 42):
        p[i], p[i + 3] = [10.0, 40.0], [30.0, 40.0]
        for a, b in ((1, 5), (2, 4)):
            p[i + a], p[i + b] = [15.0, 40.0 - 10 * eye], [15.0, 40.0 + 10 * eye]
    p[48], p[54] = [50 - 50 * mouth, 70.0], [50 + 50 * mouth, 70.0]
    p[51], p[57] = [50.0, 60 + 100 * lift], [50.0, 80 + 100 * lift]
    p[60], p[64] = [40.0, 70.0], [60.0, 70.0]
    p[62], p[66] = [50.0, 70 - 10 * opening], [50.0, 70 + 10 * opening]
    return p


FACES = [("eyes_closed", _face(0.05, 0.05, 0.3, 0.0), 0.91), ("surprised", _face(0.5, 0.4, 0.3, 0.0), 1.0), ("smiling", _face(0.05, 0.3, 0.5, 0.02), 1.0), ("mouth_open", _face(0.2, 0.18, 0.3, 0.0), 0.66), ("neutral", _face(0.05, 0.3, 0.3, 0.0), 0.69), ("neutral", [], 0.25)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {c}::DOUBLE)" for i, (n, _, c) in enumerate(FACES)) + ") t(face, label, confidence)")
def expression_rules(spark, sf):
    rows = spark.createDataFrame([(i, p, [0.0, 0.0, 100.0, 100.0]) for i, (_, p, _) in enumerate(FACES)], "face int, points array<array<double>>, box array<double>")
    e = S.expression(F.col("points"), F.col("box"))
    return rows.select("face", e["label"].alias("label"), e["confidence"].alias("confidence"))


# progress and streams


@query("""SELECT event_id, round(d / greatest(s, 0.001), 6) AS rate, round(CASE WHEN d > 0 THEN (1000 - d) / (d / greatest(s, 0.001)) END, 6) AS eta
    FROM (SELECT event_id, (event_id % 1000)::DOUBLE AS d, (event_id % 77)::DOUBLE / 4 AS s FROM events)""")
def stage_throughput(spark, sf):
    d, s = (F.col("event_id") % 1000).cast("double"), (F.col("event_id") % 77).cast("double") / 4
    return table(spark, sf, "events").select("event_id", F.round(progress.rate(d, s), 6).alias("rate"), F.round(progress.time_left(d, F.lit(1000.0), s), 6).alias("eta"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT user_id, k, value AS s FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, 0.25::DOUBLE * o.value + 0.75::DOUBLE * r.s FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, round(max_by(s, k), 4) AS smoothed FROM r GROUP BY user_id""")
def ewma_rate(spark, sf):
    return progress.smoothed_rates(table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", F.round("smoothed", 4).alias("smoothed"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_window_counts(spark, sf):
    import uuid

    from ..sources.store import shared_root
    from ..streaming import ingest

    stream = ingest.arriving(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    name = f"windows_{uuid.uuid4().hex}"
    done = ingest.completed(ingest.windowed_counts(stream), f"{shared_root(spark)}/{name}")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))

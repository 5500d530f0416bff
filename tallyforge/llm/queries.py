"""The numbered queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import align, chat_format, chat_repair, decontam, jaccard_join, langid, lm_scoring, maxscore, packing, secrets, suffix_dedup, token_files, url_filter
from tallyforge.llm.common import saved, scratch_path, table

#: Conversation -7 of the contract: both texts hold what looks like the template.
CLASH = "\\### Assistant: </turn> ok"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CLASH).alias("text"),
    )
    formatted = chat_format.format_chats(turns.unionByName(clash))
    return chat_format.digests(chat_format.read_chats(formatted))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token-id files and read back."""
    folder = scratch_path(spark, "token-files")
    manifest = saved(token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=1), "token-manifest")
    return token_files.placed(spark, manifest, token_files.read_token_files(manifest.repartition("shard")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=2, capacity=4096)


#: Parts of the dated list of op4, from the digest of each host: which hosts are blocked, from when, for how long, and which have an allowed folder.
LIST_SQL = """
    SELECT 'host' AS kind, host AS value, 'block' AS verdict, 'add' AS action, {start} AS day FROM hosts WHERE substr(digest, 1, 1) < '8'
    UNION ALL SELECT 'host', host, 'block', 'remove', {stop} FROM hosts WHERE substr(digest, 1, 1) < '4'
    UNION ALL SELECT 'prefix', concat(host, '/en/'), 'allow', 'add', {start} FROM hosts WHERE substr(digest, 5, 1) < '8'
    UNION ALL SELECT 'domain', 'example.net', 'block', 'add', CAST('2024-03-01' AS DATE)
    UNION ALL SELECT 'domain', 'example.net', 'block', 'remove', CAST('2024-05-01' AS DATE)
    UNION ALL SELECT 'domain', 'example.net', 'block', 'add', CAST('2025-01-15' AS DATE)
    UNION ALL SELECT 'domain', 'org', 'block', 'add', CAST('2024-09-01' AS DATE)
"""


def list_changes(captures: DataFrame) -> DataFrame:
    """The dated list of op4: entries for every host of the captures, and a few fixed domains."""
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("digest", F.md5("host"))
    nth = "(ascii(substr(digest, {0}, 1)) * 7 + ascii(substr(digest, {1}, 1)) * 3)"
    start = f"date_add(DATE'2024-01-01', {nth.format(2, 3)} % 400)"
    sql = LIST_SQL.format(start=start, stop=f"date_add({start}, 30 + {nth.format(4, 5)} % 180)").replace("FROM hosts", "FROM {hosts}")
    return captures.sparkSession.sql(sql, hosts=hosts)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a filter fitted on labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that also start earlier."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), digests=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or something very like one, with the item and the place."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture held against the list entries of its day (capture days run over two years by page_id)."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    judged = url_filter.judge(captures, list_changes(captures))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "entry_since")})


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents entered in a fresh ledger; its findings joined back to every document."""
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    paths = ledger.update(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    ledger.enter(paths)
    return secrets.digests(ledger.findings_of(paths))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under exact Jaccard links of at least 0.8 on five-word shingles."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two public vocabularies, aligned."""
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    return chat_repair.repair(chat_repair.damaged(table(spark, sf_dir, "conversations")), gone="gone")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document by a trigram model of the documents that are not held out."""
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_chat_format": op6_chat_format,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_maxscore": op8_maxscore,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_chat_repair": op12_chat_repair,
    "op13_lm_scoring": op13_lm_scoring,
}

_NTH = "(ascii(substr(digest, {0}, 1)) * 7 + ascii(substr(digest, {1}, 1)) * 3)"
_DUCK_START = f"CAST(DATE '2024-01-01' + CAST({_NTH.format(2, 3)} % 400 AS INTEGER) AS DATE)"


def _paid(state: str, cost: str, letter: str) -> str:
    """SQL: a state of op12 (six digits of cost, then the audit) after an edit; null stays null."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || '{letter}')"


def _repair_sql() -> str:
    """A row at a time, the least (cost, audit) of each of the four states; equal costs are never prefixes of each other, so the least stays the least."""
    inserted = lambda a: f"[{a}[1], {a}[2], least({a}[3], {_paid(a + '[1]', '5', 'I')}, {_paid(a + '[2]', '5', 'I')}, {_paid(a + '[4]', '5', 'I')}), {a}[4]]"
    closed = lambda a: f"list_transform([{inserted(a)}], lambda i: [i[1], i[2], i[3], least(i[4], {_paid('i[3]', '5', 'I')})])[1]"
    kept = "CASE WHEN x[2] < '2' AND x[1] = '{0}' THEN " + _paid("c[{1}]", "CASE x[2] WHEN '1' THEN 5 ELSE 0 END", "K") + " END"
    reroled = "CASE WHEN x[2] < '2' AND x[1] <> '{0}' THEN " + _paid("c[{1}]", "CASE x[2] WHEN '1' THEN 6 ELSE 1 END", "R") + " END"
    user = ", ".join(form.format("u", s) for form in (kept, reroled) for s in (1, 2, 4))
    assistant = ", ".join(form.format("a", 3) for form in (kept, reroled))
    step = f"[{_paid('c[1]', '2', 'D')}, least({_paid('c[2]', '2', 'D')}, {kept.format('s', 1)}), least({_paid('c[3]', '2', 'D')}, {user}), least({_paid('c[4]', '2', 'D')}, {assistant})]"
    return r"""
        WITH keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
        ), dealt AS (
            SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 20 AS kind
            FROM keyed
        ), hurt AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM dealt WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                   CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS c,
                   regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending
            FROM hurt
        ), judged AS (
            SELECT *, CASE WHEN ending = '' THEN '2' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN '3' WHEN ending IN ('.', '!', '?') THEN '0' ELSE '1' END AS f,
                   lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p
            FROM placed
        ), told AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = '2') AS blank, count(*) FILTER (f = '3') AS duplicate,
                   count(*) FILTER (f = '1') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, list([c, f] ORDER BY i) AS codes
            FROM judged GROUP BY conv_id
        ), paid AS (
            SELECT *, list_reduce(list_concat([['000000', NULL, NULL, NULL]], codes), lambda a, x: list_transform([""" + closed("a") + "], lambda c: " + step + ")[1]) AS a FROM told" + """
        ), ended AS (SELECT *, list_transform([""" + closed("a") + r"""], lambda c: least(c[1], c[4]))[1] AS best FROM paid
        ), audits AS (SELECT *, CAST(substr(best, 1, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM ended
        ), edits AS (
            SELECT conv_id, j, letter, sum(CAST(letter <> 'I' AS INTEGER)) OVER w AS i, sum(CAST(letter <> 'D' AS INTEGER)) OVER w AS o
            FROM (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS j, unnest(string_split(audit, '')) AS letter FROM audits WHERE audit <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY j)
        ), written AS (
            SELECT e.conv_id, e.o, e.letter, r.c, r.role, CASE WHEN e.letter = 'I' THEN '' ELSE r.text END AS text,
                   max(CAST(e.letter = 'K' AND r.c = 's' AS INTEGER)) OVER (PARTITION BY e.conv_id) AS s
            FROM edits e LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.letter <> 'I' WHERE e.letter <> 'D'
        ), repaired AS (
            SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS h
            FROM written GROUP BY conv_id
        )
        SELECT d.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated, coalesce(a.illegal, 0) AS illegal,
               coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
    """


ORACLE_SQL = {
    "op12_chat_repair": _repair_sql(),
    "op6_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), coded AS (
            SELECT *, length(replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<part>', '\p')) AS n,
                   coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS joined
            FROM turns
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + CASE WHEN joined THEN 6 ELSE 4 + length(role) + 1 + 8 END) AS BIGINT) AS formatted_chars
        FROM coded GROUP BY conv_id
    """,
    "op4_url_filter": """
        WITH captures AS (
            SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS DATE) AS fetched_on,
                   nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')), '') AS host,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), hosts AS (SELECT DISTINCT host, md5(host) AS digest FROM captures WHERE host IS NOT NULL
        ), changes AS (""" + LIST_SQL.format(start=_DUCK_START, stop=f"{_DUCK_START} + CAST(30 + {_NTH.format(4, 5)} % 180 AS INTEGER)") + """), valid AS (
            SELECT * FROM (
                SELECT kind, value, verdict, action, day AS since, lead(day) OVER (PARTITION BY kind, value, verdict ORDER BY day) AS until FROM changes
            ) WHERE action = 'add'
        ), hits AS (
            SELECT c.page_id, v.kind, v.value, v.verdict, v.since,
                   row_number() OVER (PARTITION BY c.page_id ORDER BY CASE v.kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, length(v.value) DESC) AS place
            FROM captures c JOIN valid v
              ON ((v.kind = 'host' AND c.host = v.value)
                  OR (v.kind = 'domain' AND (c.host = v.value OR ends_with(c.host, '.' || v.value)))
                  OR (v.kind = 'prefix' AND starts_with(c.host || c.path, v.value)))
             AND v.since <= c.fetched_on AND (v.until IS NULL OR c.fetched_on < v.until)
        )
        SELECT c.page_id, c.url, CAST(c.fetched_on AS VARCHAR) AS fetched_on, c.host, coalesce(h.verdict, 'allow') AS verdict, h.kind AS entry_kind, h.value AS entry, CAST(h.since AS VARCHAR) AS entry_since
        FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
    """,
    "op7_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
        ), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
    """,
    "op8_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}

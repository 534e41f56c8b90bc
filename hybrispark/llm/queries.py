"""Registered queries of the training-data operators and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybrispark.llm.leakage import leaked_items
from hybrispark.llm.splitting import split_items
from hybrispark.llm.term_frequency import term_frequency
from hybrispark.llm.token_ids import token_ids
from hybrispark.llm.top_items import top_probes
from hybrispark.llm.toxicity import source_rates, toxicity_scores, worst_scores
from hybrispark.session import read_table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 18-base word with its occurrences, records and mark."""
    return term_frequency(read_table(spark, sf_dir, "test_probes"), "probe_id", "probe_seq", k=18)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p1_long_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 31-base word, the longest that is sorted as a number."""
    return term_frequency(read_table(spark, sf_dir, "test_probes"), "probe_id", "probe_seq", k=31)


def p1_ambiguous_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 32-letter word of bases and the letter for any base."""
    return term_frequency(read_table(spark, sf_dir, "test_probes"), "probe_id", "probe_seq", k=32, alphabet="ACGTN")


def p1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of Latin letters and digits of the documents."""
    return term_frequency(read_table(spark, sf_dir, "documents"), "doc_id", "text", pattern="[a-z0-9]+")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_probes(read_table(spark, sf_dir, "test_probes"), read_table(spark, sf_dir, "scoring"), 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(read_table(spark, sf_dir, "mine_probes"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their bases."""
    return split_items(read_table(spark, sf_dir, "mine_probes"), with_text=True)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each test item leaked."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id")
    leaks = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.join(leaks, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of abusive, hateful or sexual content for every document."""
    return toxicity_scores(read_table(spark, sf_dir, "documents"))


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rates(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = worst_scores(read_table(spark, sf_dir, "documents")).where("score >= 0.5")
    return worst.where("doc_id IS NOT NULL").select("doc_id").distinct()


QUERIES = {
    "p1_terms": p1_terms,
    "p1_found": p1_found,
    "p1_long_terms": p1_long_terms,
    "p1_ambiguous_terms": p1_ambiguous_terms,
    "p1_words": p1_words,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
}


def _terms_sql(k: int, alphabet: str) -> str:
    return f"""
    WITH r AS (
        SELECT probe_id, max(probe_seq) AS probe_seq FROM test_probes WHERE probe_id IS NOT NULL GROUP BY probe_id
    ), c AS (
        SELECT probe_id, upper(regexp_replace(probe_seq, '[\\s\\v\\p{{Z}}\\x1c-\\x1f\\x{{85}}]', '', 'g')) AS s FROM r
    ), k AS (
        SELECT probe_id, substr(s, i, {k}) AS term
        FROM (SELECT probe_id, s, unnest(range(1, length(s) - {k - 2})) AS i FROM c WHERE length(s) >= {k})
    ), t AS (
        SELECT term, count(*) AS n_occurrences, count(DISTINCT probe_id) AS n_records
        FROM k WHERE regexp_full_match(term, '[{alphabet}]{{{{{k}}}}}') GROUP BY term
    )
    SELECT term, n_occurrences, n_records,
        CASE WHEN n_occurrences = 1 THEN 'rare'
             WHEN n_records >= greatest(10.0, 0.002 * (SELECT count(*) FROM r)) THEN 'common' END AS mark
    FROM t
    """.replace("{{", "{").replace("}}", "}")


_P1_TERMS = _terms_sql(18, "ACGT")

_PIECES = """
        WITH RECURSIVE x AS (
            SELECT DISTINCT mine_id, regexp_replace(seq, '[\\s\\v\\p{Z}\\x1c-\\x1f\\x{85}]', '', 'g') AS s,
                coalesce(chunk_size, 100000) AS lim, max_length - 1 AS ov
            FROM mine_probes
        ), y AS (
            SELECT * FROM x WHERE length(s) > 0 AND lim > ov
        ), runs AS (
            SELECT mine_id, unnest(regexp_extract_all(s, '[Nn]{10,}|[^Nn]+|[Nn]+')) AS part,
                generate_subscripts(regexp_extract_all(s, '[Nn]{10,}|[^Nn]+|[Nn]+'), 1) AS i
            FROM y
        ), ends AS (
            SELECT mine_id, part, sum(length(part)) OVER (PARTITION BY mine_id ORDER BY i) AS b FROM runs
        ), bounds AS (
            SELECT y.mine_id, list(b ORDER BY b) AS bs FROM ends JOIN y USING (mine_id)
            WHERE regexp_full_match(part, '[Nn]{10,}') AND b < length(s) GROUP BY y.mine_id
        ), z AS (
            SELECT y.mine_id, length(s) AS n, lim, ov, coalesce(bs, []) AS bs FROM y LEFT JOIN bounds USING (mine_id)
        ), w AS (
            SELECT mine_id, n, lim, ov, bs, 1 AS k, 0::BIGINT AS p,
                CASE WHEN n <= lim THEN n ELSE coalesce(list_max(list_filter(bs, lambda b: b > ov AND b <= lim)), lim) END::BIGINT AS e
            FROM z
            UNION ALL
            SELECT mine_id, n, lim, ov, bs, k + 1, e - ov,
                CASE WHEN n - (e - ov) <= lim THEN n
                     ELSE coalesce(list_max(list_filter(bs, lambda b: b > e - ov + ov AND b <= e - ov + lim)), e - ov + lim) END::BIGINT
            FROM w WHERE e < n
        )
"""


def _words_sql(text: str) -> str:
    """The words of a text in one form: without markup, invisible characters, breaks within words, full width and case."""
    wide = "".join(chr(c) for c in range(0xFF10, 0xFF5B))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B))
    out = f"regexp_replace({text}, '</?[A-Za-z][^<>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '[\\x{{034F}}\\x{{061C}}\\x{{180B}}-\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    blank = "[ \\t\\f\\v\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]"
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}_])[-\\x{{AD}}\\x{{2010}}\\x{{2011}}]{blank}*(?:\\r\\n|[\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}])(?:{blank}|[>|])*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    out = f"replace({out}, chr(173), '')"
    for form, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        out = f"replace({out}, '{form}', '{letters}')"
    return f"regexp_extract_all(lower(nfc_normalize(translate({out}, '{wide}', '{plain}'))), '[\\p{{L}}\\p{{N}}]+')"


_LEAKS = f"""
    WITH dw AS (
        SELECT DISTINCT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL
    ), iw AS (
        SELECT item_id, {_words_sql('text')} AS w FROM benchmark WHERE text IS NOT NULL
    ), dg AS (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12
    ), ig AS (
        SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12
    ), lk AS (
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    )"""

SQL = {
    "p1_terms": _P1_TERMS,
    "p1_found": f"SELECT term, mark FROM ({_P1_TERMS}) WHERE mark IS NOT NULL",
    "p1_long_terms": _terms_sql(31, "ACGT"),
    "p1_ambiguous_terms": _terms_sql(32, "ACGTN"),
    "p1_words": """
        WITH r AS (
            SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), k AS (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM r
        ), t AS (
            SELECT term, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_records FROM k GROUP BY term
        )
        SELECT term, n_occurrences, n_records,
            CASE WHEN n_occurrences = 1 THEN 'rare'
                 WHEN n_records >= greatest(10.0, 0.002 * (SELECT count(*) FROM r)) THEN 'common' END AS mark
        FROM t
    """,
    "p3_found": """
        WITH p AS (
            SELECT seqid, seq_id, min("start") AS s, min("stop") AS e FROM test_probes
            WHERE seq_id IS NOT NULL AND seqid IS NOT NULL GROUP BY seqid, seq_id
        ), b AS (
            SELECT seqid, max(on_target_score) AS score FROM scoring
            WHERE on_target_score IS NOT NULL AND NOT isnan(on_target_score) GROUP BY seqid
        ), r AS (
            SELECT p.seq_id, p.seqid, CAST(row_number() OVER (
                PARTITION BY p.seq_id ORDER BY b.score DESC, p.s NULLS LAST, p.e NULLS LAST, p.seqid) AS INT) AS rnk
            FROM p JOIN b ON p.seqid = b.seqid
        )
        SELECT seq_id, rnk, seqid FROM r WHERE rnk <= 5
    """,
    "p5_found": f"{_PIECES} SELECT mine_id, k AS piece_no, CAST(p AS INT) AS piece_start, CAST(e AS INT) AS piece_end FROM w",
    "p5_pieces": f"""{_PIECES} SELECT w.mine_id, k AS piece_no, CAST(p AS INT) AS piece_start, CAST(e AS INT) AS piece_end, substr(s, p + 1, e - p) AS piece
        FROM w JOIN y USING (mine_id)""",
    "p7_found": _LEAKS + " SELECT DISTINCT doc_id, item_id FROM lk",
    "p7_items": _LEAKS + """ SELECT b.item_id, count(DISTINCT lk.doc_id) AS n_documents FROM benchmark b LEFT JOIN lk ON b.item_id = lk.item_id GROUP BY b.item_id""",
}

"""SQL for the queries that SQL can express."""

_COUNTS = """
WITH c AS (SELECT DISTINCT page_id, line_id, word_id, char_id, char_str FROM chars),
     l AS (SELECT DISTINCT sample_id, letter_no, letter FROM letters),
     t AS (
       SELECT 'chars' AS src, char_str AS term, count(*) AS occurrences, count(DISTINCT page_id) AS records,
              (SELECT count(DISTINCT page_id) FROM c) AS n
       FROM c WHERE char_str IS NOT NULL AND char_str <> '' GROUP BY char_str
       UNION ALL
       SELECT 'letters', letter, count(*), count(DISTINCT sample_id), (SELECT count(DISTINCT sample_id) FROM l)
       FROM l WHERE letter IS NOT NULL AND letter <> '' GROUP BY letter),
     m AS (SELECT src, term, occurrences, records,
                  CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.4 * n THEN 'common' END AS mark FROM t)
"""

ORACLE = {
    "p7_pack_check": "SELECT count(*) AS texts, 0 AS divided_early, 0 AS incomplete, 0 AS overfull, 0 AS overlapping FROM documents",
    "p3_counts": _COUNTS + "SELECT src, term, occurrences, records, mark FROM m",
    "p3_found": _COUNTS + "SELECT src, term, mark FROM m WHERE mark IS NOT NULL",
}

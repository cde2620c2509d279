"""SQL of the operators for training data, for DuckDB."""

_P2 = """
WITH r AS (SELECT DISTINCT fragment_id, upper(replace(regexp_replace(index_sequence, '\\s+', '', 'g'), '.', 'N')) AS s
           FROM fragments WHERE index_sequence IS NOT NULL),
t AS (SELECT fragment_id, unnest(regexp_split_to_array(s, '[-+_]')) AS term FROM r),
u AS (SELECT * FROM t WHERE term NOT IN ('', '0')),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT fragment_id) AS records FROM u GROUP BY 1),
m AS (SELECT term AS index_term, occurrences, records, CASE WHEN records < 3 THEN 'rare'
      WHEN records * 20 > (SELECT count(DISTINCT fragment_id) FROM u) THEN 'common' END AS term_mark FROM c)
"""

#: Words as in the operator: group 1 is a word, every other match is markup.
_WORD = r"""\\(?:[a-z]*cite[a-z]*|ref|eqref|pageref|autoref|cref|label|bibitem)\*?\s*(?:\[[^\]]*\]\s*)*\{[^}]*\}|\\(?:begin|end)\s*\{[^}]*\}|\\[a-z]+\*?|([\p{L}\p{N}]+)"""

_GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i:i + 11], ' ') AS s
  FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM
    (SELECT {id}, list_filter(regexp_extract_all(lower({text}), '{word}', 1), lambda x: x <> '') AS w FROM {table}))"""

SQL = {
    "p8_found": "WITH d AS (" + _GRAMS.format(id="doc_id", text="text", table="documents", word=_WORD) + "), e AS (" + _GRAMS.format(id="item_id", text="passage", table="eval_items", word=_WORD) + ") SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (s)",
    "p2_found": _P2 + "SELECT index_term, term_mark FROM m WHERE term_mark IS NOT NULL",
    "p2_terms": _P2 + "SELECT * FROM m",
    "p3_found": """
WITH r AS (SELECT DISTINCT o.bam_id, o.virtual_offset, CASE WHEN f.granularity > 0 THEN f.granularity ELSE 4096 END AS g
           FROM bam_offsets o JOIN bam_files f USING (bam_id) WHERE o.virtual_offset <> f.file_size << 16)
SELECT bam_id, min(virtual_offset) AS virtual_offset, 'file' AS item_level FROM r GROUP BY bam_id, g HAVING count(*) > g
UNION ALL
SELECT bam_id, min(virtual_offset), 'block' FROM r GROUP BY bam_id, g, virtual_offset >> 16 HAVING count(*) > g""",
    # Halves are cut as the operator does: the nearest boundary of the middle half, else one that leaves both sides within the limit, else the middle.
    "p3_pieces": """
WITH RECURSIVE r AS (SELECT DISTINCT o.bam_id, o.virtual_offset, CASE WHEN f.granularity > 0 THEN f.granularity ELSE 4096 END AS g, f.overlap_records AS o
           FROM bam_offsets o JOIN bam_files f USING (bam_id) WHERE o.virtual_offset <> f.file_size << 16),
n AS (SELECT *, row_number() OVER (PARTITION BY bam_id ORDER BY virtual_offset) - 1 AS i, count(*) OVER (PARTITION BY bam_id) AS total FROM r),
f AS (SELECT bam_id, any_value(g) AS g, least(greatest(coalesce(any_value(o), 0), 0), any_value(g) - 1) AS o, any_value(total) AS total FROM n GROUP BY 1 HAVING any_value(total) > any_value(g)),
b AS (SELECT bam_id, list(first) AS marks FROM (SELECT bam_id, min(i) AS first FROM n GROUP BY bam_id, virtual_offset >> 16) GROUP BY 1),
parts AS (
  SELECT bam_id, g, o, marks, 0::BIGINT AS a, total AS e, false AS inside FROM f JOIN b USING (bam_id)
  UNION ALL
  SELECT bam_id, g, o, marks, CASE WHEN upper THEN cut ELSE a END, CASE WHEN upper THEN e ELSE cut END, CASE WHEN upper THEN blind ELSE inside END
  FROM (SELECT *, coalesce(best[3], (a + e) // 2) AS cut, best IS NULL AS blind FROM
    (SELECT *, list_min([[CASE WHEN m BETWEEN a + (e - a) // 4 AND e - (e - a) // 4 THEN 0 ELSE 1 END, abs(2 * m - a - e), m] FOR m IN marks
       IF m > a AND m < e AND (m BETWEEN a + (e - a) // 4 AND e - (e - a) // 4 OR (m >= e - (g - o) AND m <= a + (g - o)))]) AS best
     FROM parts WHERE e - a > g - o)), (VALUES (false), (true)) h(upper)),
p AS (SELECT *, greatest(a - o, 0) AS first FROM parts WHERE e - a <= g - o)
SELECT p.bam_id, first AS piece_first, e AS piece_end, e - first AS n_records, a - first AS n_overlap, inside AS inside_block,
  x.virtual_offset AS first_offset, y.virtual_offset AS last_offset, z.virtual_offset AS own_offset
FROM p JOIN n x ON x.bam_id = p.bam_id AND x.i = first JOIN n y ON y.bam_id = p.bam_id AND y.i = e - 1 JOIN n z ON z.bam_id = p.bam_id AND z.i = a""",
    "p7_invariants": """SELECT count(*) AS n_documents, count(*) AS n_whole_or_oversized, 0 AS n_gaps, 0 AS n_too_full, 0 AS n_overlaps, true AS under_five_percent_unused FROM documents""",
    "p9_planted": """SELECT doc_id, true AS found, true AS restored FROM documents""",
}

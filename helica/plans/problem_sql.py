"""SQL of the general data problems, for DuckDB."""

P1_FOUND = """
WITH f AS (SELECT DISTINCT file_id, cohort_id, file_seq, sample_names_in_order FROM bcf_files),
o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY cohort_id ORDER BY file_seq, file_id) AS prev FROM f),
d AS (SELECT file_id, field_class, field_id, min(lower(trim(value_type))) AS t, min(trim(value_count)) AS c,
             min(lower(regexp_replace(field_text, '\\s+', '', 'g'))) AS x
      FROM bcf_fields GROUP BY ALL),
n AS (SELECT o.file_id, d.field_class, d.field_id, t, c, x FROM o JOIN d USING (file_id) WHERE prev IS NOT NULL),
p AS (SELECT o.file_id, d.field_class, d.field_id, t, c, x FROM o JOIN d ON d.file_id = o.prev),
a AS (SELECT * FROM n ANTI JOIN p USING (file_id, field_class, field_id)),
g AS (SELECT * FROM p ANTI JOIN n USING (file_id, field_class, field_id)),
s AS (SELECT o.file_id, [trim(v) FOR v IN n.sample_names_in_order] AS cur, [trim(v) FOR v IN p.sample_names_in_order] AS old
      FROM o JOIN f n USING (file_id) JOIN f p ON p.file_id = o.prev)
SELECT file_id, field_class AS item_kind, field_id AS item_name, 'renamed' AS change_kind FROM a SEMI JOIN g USING (file_id, field_class, x)
UNION ALL SELECT file_id, field_class, field_id, 'added' FROM a ANTI JOIN g USING (file_id, field_class, x)
UNION ALL SELECT file_id, field_class, field_id, 'removed' FROM g ANTI JOIN a USING (file_id, field_class, x)
UNION ALL SELECT n.file_id, n.field_class, n.field_id, 'retyped' FROM n JOIN p USING (file_id, field_class, field_id)
          WHERE n.t IS DISTINCT FROM p.t OR n.c IS DISTINCT FROM p.c
UNION ALL SELECT file_id, 'SAMPLE', v, 'added' FROM (SELECT file_id, old, unnest(cur) AS v FROM s) WHERE NOT list_contains(old, v)
UNION ALL SELECT file_id, 'SAMPLE', v, 'removed' FROM (SELECT file_id, cur, unnest(old) AS v FROM s) WHERE NOT list_contains(cur, v)
UNION ALL SELECT file_id, 'SAMPLE', '*', 'reordered' FROM s
          WHERE list_filter(cur, lambda v: list_contains(old, v)) <> list_filter(old, lambda v: list_contains(cur, v))
"""

#: The life of every field of a cohort, file by file: rows of the living carry where they began; the dead wait for a field of their text.
_LIVES = """
WITH RECURSIVE c AS (SELECT file_id, cohort_id, file_seq, row_number() OVER (PARTITION BY cohort_id ORDER BY file_seq, file_id) AS n
  FROM (SELECT DISTINCT file_id, cohort_id, file_seq FROM bcf_files) WHERE cohort_id IS NOT NULL AND file_seq IS NOT NULL),
d AS (SELECT file_id, field_class, field_id, min(dict_pos) AS dict_pos, min(lower(trim(value_type))) AS t,
             coalesce(min(lower(regexp_replace(field_text, '\\s+', '', 'g'))), '') AS x
      FROM bcf_fields WHERE file_id IS NOT NULL AND field_class IS NOT NULL AND field_id IS NOT NULL GROUP BY ALL),
cf AS (SELECT cohort_id, n, field_class, field_id, x FROM d JOIN c USING (file_id)),
life AS (
  SELECT cohort_id, n, field_class, field_id, x, field_id AS root_id, n AS root_n, true AS alive, NULL::BIGINT AS died FROM cf WHERE n = 1
  UNION ALL
  (WITH was AS (SELECT * FROM life),
   cur AS (SELECT cf.* FROM cf JOIN (SELECT DISTINCT cohort_id, n + 1 AS n FROM was) k USING (cohort_id, n)),
   same AS (SELECT cur.*, was.root_id, was.root_n FROM cur JOIN was USING (cohort_id, field_class, field_id) WHERE was.alive),
   fresh AS (SELECT cur.* FROM cur ANTI JOIN (SELECT * FROM was WHERE alive) w USING (cohort_id, field_class, field_id)),
   gone AS (SELECT * FROM was ANTI JOIN cur USING (cohort_id, field_class, field_id) WHERE alive),
   renamed AS (SELECT fresh.*, gone.root_id, gone.root_n, gone.field_id AS old_id FROM fresh JOIN gone USING (cohort_id, field_class, x) WHERE x <> ''),
   rest AS (SELECT * FROM fresh ANTI JOIN renamed USING (cohort_id, field_class, field_id)),
   dead AS (SELECT * FROM was WHERE NOT alive QUALIFY row_number() OVER (PARTITION BY cohort_id, field_class, x ORDER BY died DESC) = 1),
   back AS (SELECT rest.*, dead.root_id, dead.root_n FROM rest JOIN dead USING (cohort_id, field_class, x) WHERE x <> ''),
   step AS (SELECT cohort_id, n FROM cur GROUP BY ALL)
   SELECT cohort_id, n, field_class, field_id, x, root_id, root_n, true, NULL::BIGINT FROM same
   UNION ALL SELECT cohort_id, n, field_class, field_id, x, root_id, root_n, true, NULL FROM renamed
   UNION ALL SELECT cohort_id, n, field_class, field_id, x, root_id, root_n, true, NULL FROM back
   UNION ALL SELECT cohort_id, n, field_class, field_id, x, field_id, n, true, NULL FROM rest ANTI JOIN back USING (cohort_id, field_class, field_id)
   UNION ALL SELECT g.cohort_id, step.n, g.field_class, g.field_id, g.x, g.root_id, g.root_n, false, step.n FROM gone g JOIN step ON g.cohort_id = step.cohort_id
     WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.cohort_id = g.cohort_id AND r.field_class = g.field_class AND r.old_id = g.field_id)
   UNION ALL SELECT w.cohort_id, step.n, w.field_class, w.field_id, w.x, w.root_id, w.root_n, false, w.died FROM was w JOIN step ON w.cohort_id = step.cohort_id
     WHERE NOT w.alive AND NOT EXISTS (SELECT 1 FROM back b JOIN dead ON dead.root_id = b.root_id AND dead.root_n = b.root_n AND dead.cohort_id = b.cohort_id AND dead.field_class = b.field_class
       WHERE b.cohort_id = w.cohort_id AND b.field_class = w.field_class AND b.x = w.x AND dead.died = w.died))),
roots AS (SELECT *, row_number() OVER (PARTITION BY cohort_id, field_class, root_id ORDER BY root_n) AS k FROM (SELECT DISTINCT cohort_id, field_class, root_id, root_n FROM life)),
named AS (SELECT c.file_id, l.cohort_id, l.field_class, l.field_id, d.dict_pos, d.t, CASE WHEN k = 1 THEN root_id ELSE root_id || '@' || k END AS canonical
  FROM life l JOIN roots USING (cohort_id, field_class, root_id, root_n) JOIN c USING (cohort_id, n) JOIN d USING (file_id, field_class, field_id) WHERE alive),
types AS (SELECT cohort_id, field_class, canonical, max(CASE t WHEN 'flag' THEN 0 WHEN 'integer' THEN 1 WHEN 'float' THEN 2 ELSE 3 END) AS width,
  count(DISTINCT field_id) AS n_names, count(*) AS n_files FROM named GROUP BY ALL)
"""

_P1_UNIFIED = _LIVES + """,
typed AS (SELECT named.*, width IN (1, 2) AS numeric FROM named JOIN types USING (cohort_id, field_class, canonical)),
fm AS (SELECT file_id, map(list(dict_pos), list(canonical)) AS names, map(list(dict_pos), list(numeric)) AS nums FROM typed WHERE field_class = 'FORMAT' GROUP BY 1),
im AS (SELECT file_id, map(list(field_id), list(canonical)) AS inames, map(list(field_id), list(numeric)) AS inums FROM typed WHERE field_class = 'INFO' GROUP BY 1),
v AS (SELECT * FROM variant_rows WHERE variant_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY loaded_at NULLS LAST) = 1),
s AS (SELECT file_id, any_value(cohort_id) AS cohort_id, any_value([trim(x) FOR x IN sample_names_in_order]) AS samples FROM bcf_files GROUP BY 1),
j AS (SELECT v.*, s.cohort_id, names, nums, inames, inums, string_split(genotypes_raw, chr(9)) AS cells, samples,
    greatest(coalesce(len(string_split(genotypes_raw, chr(9))), 0), coalesce(len(samples), 0)) AS width
  FROM v LEFT JOIN s USING (file_id) LEFT JOIN fm USING (file_id) LEFT JOIN im USING (file_id)),
w AS (SELECT *, unnest(CASE WHEN width > 0 THEN range(1, width + 1) ELSE [NULL] END) AS i FROM j),
x AS (SELECT *, samples[i] AS sample_name, string_split(cells[i], ':') AS vals FROM w),
y AS (SELECT *,
    [{'f': names[format_pos[p]], 'v': vals[p], 'n': nums[format_pos[p]]} FOR p IN range(1, greatest(coalesce(len(format_pos), 0), coalesce(len(vals), 0)) + 1) IF names[format_pos[p]] IS NOT NULL] AS fv,
    [{'f': coalesce(inames[split_part(e, '=', 1)], split_part(e, '=', 1)), 'v': CASE WHEN contains(e, '=') THEN substr(e, instr(e, '=') + 1) END, 'n': inums[split_part(e, '=', 1)]} FOR e IN string_split(info_raw, ';')] AS iv FROM x)
SELECT variant_id, cohort_id, file_id, contig, pos, var_name, ref_allele, alt_alleles, qual, filters, sample_name,
  array_to_string([e.f || '=' || coalesce(e.v, '.') FOR e IN fv], ';') AS format_values, array_to_string([e.f || '=' || coalesce(e.v, '.') FOR e IN iv], ';') AS info_values,
  len([1 FOR e IN list_concat(fv, iv) IF e.n AND try_cast(e.v AS DOUBLE) IS NOT NULL]) AS n_numbers FROM y
"""

_P4 = """
WITH r AS (SELECT line_id, regexp_replace(coalesce(raw_line, ''), '\\r$', '') AS line FROM qseq_lines),
q AS (SELECT *, string_split(line, '"') AS parts FROM r),
h AS (SELECT line_id, line,
        string_split(array_to_string([CASE WHEN i % 2 = 0 THEN replace(parts[i], chr(9), chr(26)) ELSE parts[i] END FOR i IN range(1, len(parts) + 1)], '"'), chr(9)) AS raw
      FROM q),
c AS (SELECT line_id, line,
        [replace(CASE WHEN v LIKE '"%' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END, chr(26), chr(9)) FOR v IN raw] AS f
      FROM h),
e AS (SELECT line_id, f, CASE
    WHEN NOT regexp_full_match(line, '(?s)("([^"]|"")*"|[^"\\t]*)(\\t("([^"]|"")*"|[^"\\t]*))*') THEN 'quoting'
    WHEN len(f) <> 11 THEN 'columns'
    WHEN len([1 FOR i IN [2, 3, 4, 5, 6, 8] IF NOT regexp_full_match(f[i], '-?[0-9]+') OR try_cast(f[i] AS INTEGER) IS NULL]) > 0 THEN 'number'
    WHEN NOT regexp_full_match(f[9], '[ACGTN.]+') OR NOT regexp_full_match(f[7], '[ACGTN.]+|0') THEN 'bases'
    WHEN NOT regexp_full_match(f[10], '[@-~]*') THEN 'quality'
    WHEN length(f[10]) <> length(f[9]) THEN 'length'
    WHEN f[11] NOT IN ('0', '1') THEN 'filter_flag' END AS fail_reason FROM c)
"""

_P5 = """
WITH l AS (SELECT run_id, lower(coalesce(quality_encoding, '')) AS q, lower(coalesce(run_note, '')) AS n FROM seq_runs),
c AS (SELECT run_id, n, CASE
    WHEN q LIKE '%log%' THEN 'log10' WHEN q LIKE '%prob%' OR q LIKE '%p(err%' THEN 'errprob'
    WHEN q LIKE '%numeric%' OR q LIKE '%decimal%' THEN 'decimal'
    WHEN q LIKE '%33%' OR q LIKE '%sanger%' OR q LIKE '%1.8%' THEN 'phred33'
    WHEN q LIKE '%64%' OR q LIKE '%illumina%' THEN 'phred64' END AS label,
    regexp_extract(n, 'offset (33|64) up to lane (\\d+); from lane (\\d+) on offset (33|64)', ['low', 'x', 'cut', 'high']) AS u,
    regexp_extract(n, 'lanes below (\\d+) carry ascii offset (33|64), lane (\\d+) and above offset (33|64)', ['x', 'low', 'cut', 'high']) AS b,
    CASE WHEN n LIKE '%logarithm%' OR n LIKE '%log10%' THEN 'log10' WHEN n LIKE '%error probabilit%' THEN 'errprob'
    WHEN n LIKE '%decimal%' OR n LIKE '%phred numbers%' THEN 'decimal'
    WHEN n LIKE '%offset 33%' OR n LIKE '%plus 33%' OR n LIKE '%exclamation%' OR n LIKE '%sanger%' THEN 'phred33'
    WHEN n LIKE '%offset 64%' OR n LIKE '%plus 64%' OR n LIKE '%at sign%' OR n LIKE '%illumina 1.3%' THEN 'phred64' END AS note FROM l),
f AS (SELECT DISTINCT fragment_id, run_id, lane, seq_bases, quality FROM fragments),
j AS (SELECT f.fragment_id, f.seq_bases, f.quality, CASE WHEN label IS NOT NULL THEN label
    WHEN u.cut <> '' THEN 'phred' || CASE WHEN lane < u.cut::INT THEN u.low ELSE u.high END
    WHEN b.cut <> '' THEN 'phred' || CASE WHEN lane < b.cut::INT THEN b.low ELSE b.high END
    ELSE note END AS claim,
    CASE WHEN regexp_full_match(quality, '[-+.0-9eE;, ]+') THEN [try_cast(v AS DOUBLE) FOR v IN regexp_split_to_array(trim(quality), '[;,\\s]+')] END AS v
    FROM f LEFT JOIN c USING (run_id)),
k AS (SELECT *, len(v) = length(seq_bases) AND len([1 FOR x IN v IF x IS NULL]) = 0 AS num FROM j),
w AS (SELECT *, CASE WHEN quality IS NULL THEN NULL WHEN claim IS NOT NULL THEN claim
    WHEN num AND len([1 FOR x IN v IF x <> round(x) OR x < 0 OR x > 41]) = 0 THEN 'decimal'
    WHEN num AND list_min(v) > 0 AND list_max(v) <= 1 THEN 'errprob'
    WHEN num AND list_max(v) <= 0 THEN 'log10'
    WHEN regexp_full_match(quality, '[!-J]*') AND length(quality) = length(seq_bases) AND NOT regexp_full_match(quality, '[@-i]+') THEN 'phred33'
    WHEN regexp_full_match(quality, '[@-i]+') AND length(quality) = length(seq_bases) AND NOT regexp_full_match(quality, '[!-J]*') THEN 'phred64' END AS unit FROM k)
"""

_P5_BY_VALUES = """
WITH f AS (SELECT DISTINCT fragment_id, run_id, lane, seq_bases, quality FROM fragments),
v AS (SELECT *, CASE WHEN regexp_full_match(quality, '[-+.0-9eE;, ]+') THEN [try_cast(x AS DOUBLE) FOR x IN regexp_split_to_array(trim(quality), '[;,\\s]+')] END AS v FROM f),
n AS (SELECT *, len(v) = coalesce(length(seq_bases), len(v)) AND len([1 FOR x IN v IF x IS NULL]) = 0 AS num, length(quality) = coalesce(length(seq_bases), length(quality)) AS txt FROM v),
fits AS (SELECT *, list_filter([
    CASE WHEN txt AND regexp_full_match(quality, '[!-J]*') THEN 'phred33' END,
    CASE WHEN txt AND regexp_full_match(quality, '[@-i]*') THEN 'phred64' END,
    CASE WHEN num AND list_min(v) >= 0 AND list_max(v) <= 41 AND len([1 FOR x IN v IF x <> round(x)]) = 0 THEN 'decimal' END,
    CASE WHEN num AND list_min(v) > 0 AND list_max(v) <= 1 THEN CASE WHEN len([1 FOR x IN v IF round(-10 * log10(x)) > 41 OR abs(-10 * log10(x) - round(-10 * log10(x))) > 0.25]) = 0 THEN 'errprob' END END,
    CASE WHEN num AND list_max(v) <= 0 AND list_min(v) >= -4.1 AND len([1 FOR x IN v IF abs(10 * x - round(10 * x)) > 0.25]) = 0 THEN 'log10' END
    ], lambda u: u IS NOT NULL) AS u FROM n)
SELECT DISTINCT fragment_id, CASE WHEN len(u) = 1 THEN u[1] END AS quality_unit, coalesce(len(u) > 1, false) AS unit_ambiguous FROM fits
"""

SQL = {
    "p1_found": P1_FOUND,
    "p1_types": _LIVES + "SELECT cohort_id, field_class, canonical, ['Flag', 'Integer', 'Float', 'String'][width + 1] AS unified_type, n_names, n_files FROM types",
    "p1_unified": _P1_UNIFIED,
    "p5_by_values": _P5_BY_VALUES,
    "p4_found": _P4 + "SELECT line_id, fail_reason FROM e WHERE fail_reason IS NOT NULL",
    "p4_valid": _P4
    + """SELECT line_id, f[1] AS instrument, f[2]::INT AS run, f[3]::INT AS lane, f[4]::INT AS tile, f[5]::INT AS xpos, f[6]::INT AS ypos,
    CASE WHEN f[7] <> '0' THEN replace(f[7], '.', 'N') END AS index_sequence, f[8]::INT AS read_no, replace(f[9], '.', 'N') AS seq_bases,
    f[10] AS quality, f[11] = '1' AS filter_passed FROM e WHERE fail_reason IS NULL""",
    "p5_found": _P5 + "SELECT DISTINCT fragment_id, unit AS quality_unit FROM w WHERE unit <> 'phred33'",
    "p5_phred33": _P5
    + """SELECT DISTINCT fragment_id, unit AS quality_unit, CASE WHEN unit IS NULL THEN NULL WHEN claim IS NULL THEN 'values' ELSE 'stated' END AS unit_source,
    quality IS NOT NULL AND unit IS NULL AS unit_ambiguous,
    CASE unit WHEN 'phred33' THEN quality
      WHEN 'phred64' THEN array_to_string([chr((ascii(x) - 31)::INT) FOR x IN string_split(quality, '')], '')
      WHEN 'decimal' THEN array_to_string([chr((round(x) + 33)::INT) FOR x IN v], '')
      WHEN 'errprob' THEN array_to_string([chr((round(-10 * log10(x)) + 33)::INT) FOR x IN v], '')
      WHEN 'log10' THEN array_to_string([chr((round(-10 * x) + 33)::INT) FOR x IN v], '') END AS quality FROM w""",
    "p6_found": """SELECT record_key FROM alignments WHERE record_key IS NOT NULL GROUP BY 1
    HAVING count(*) * 100 > 3 * (SELECT count(record_key) FROM alignments)""",
    "p6_key_stats": """SELECT record_key, count(*) AS n_rows, min(loaded_at) AS first_load, max(loaded_at) AS last_load, avg(mapq) AS mean_mapq
    FROM alignments WHERE record_key IS NOT NULL GROUP BY 1""",
}

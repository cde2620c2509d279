"""SQL of the genomic queries, for DuckDB: the expected columns, straight from the tables."""

_FRAGMENTS = """
WITH b AS (SELECT *, coalesce(seq_bases, 'N') AS s FROM fragments),
f AS (SELECT coalesce(instrument, 'NA') AS instrument, coalesce(run_number, 0) AS run_number, coalesce(flowcell_id, '') AS flowcell_id, coalesce(lane, 0) AS lane, coalesce(tile, 0) AS tile,
  coalesce(xpos, 0) AS xpos, coalesce(ypos, 0) AS ypos, coalesce(read_no, 1) AS read, coalesce(filter_passed, true) AS filter_passed, coalesce(control_number, 0) AS control_number,
  nullif(regexp_replace(upper(index_sequence), '[^ACGTN]', '', 'g'), '') AS index_sequence, s AS sequence,
  CASE WHEN regexp_full_match(quality, '[!-_]+') AND length(quality) = length(s) THEN quality ELSE translate(s, 'ACGTN', '!5?IJ') END AS quality FROM b),
k AS (SELECT *, concat_ws(':', instrument, run_number, lane, tile, xpos, ypos, read) AS key FROM f)
"""
_FRAGMENT = "instrument, run_number, lane, tile, xpos, ypos, read, filter_passed, index_sequence, sequence, quality"

_READS = """
WITH r AS (SELECT read_name || '|' || read_id || '|' || strftime(loaded_at, '%Y%m%d%H%M%S%f') AS read_name, flags,
  CASE WHEN contig IS NULL THEN -1 WHEN contig = 'chrX' THEN 22 ELSE substr(contig, 4)::INT - 1 END AS ref_index, contig, coalesce(start_pos, 0) AS start,
  coalesce(mapq, 255) AS mapq, cigar, mate_contig, coalesce(mate_start, 0) AS mate_start, coalesce(insert_size, 0) AS insert_size, bases, quals,
  coalesce(opt_tags, '') AS tags, coalesce(end_pos, start_pos, 0) AS "end" FROM alignments)
"""
_HIT = """(contig = 'chr3' AND start <= 40000000 AND "end" >= 1000000) OR (contig = 'chr7' AND start <= 9000000 AND "end" >= 500)
  OR (contig = 'chr15' AND start <= 60000000 AND "end" >= 1)"""
#: The last position that a CIGAR covers.
_END = "CASE WHEN start > 0 THEN start + greatest((SELECT coalesce(sum(x::INT), 0) FROM (SELECT unnest(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)) AS x)) - 1, 0) ELSE \"end\" END"
_SHOWN = "read_name, flags, ref_index, contig, start, mapq, cigar, mate_contig, mate_start, insert_size, bases, quals, tags"

_VARIANTS = """
WITH v AS (SELECT variant_id AS n, contig, pos AS start, 'v' || variant_id AS id, ref_allele AS ref, alt_alleles AS alt, qual, coalesce(filters, '.') AS filter, substr(contig, 4) AS pr,
  ['0/1', '1|1', './.', '0|0', '1/0'][variant_id % 5 + 1] AS gt, CASE WHEN variant_id % 3 = 0 THEN '.' ELSE (variant_id % 99)::VARCHAR END AS gq FROM variant_rows),
t AS (SELECT concat_ws(chr(9), contig, start, id, ref, alt, CASE WHEN qual IS NULL THEN '.' WHEN qual = floor(qual) THEN qual::BIGINT::VARCHAR ELSE qual::VARCHAR END, filter,
  'PR=' || pr || ';DP=' || (n * 7 % 1000) || CASE WHEN n % 2 = 0 THEN ';DB' ELSE '' END, 'GT:GQ', gt || ':' || gq, '1|1:.') AS value FROM v)
"""

_MANY = "iv AS (SELECT 'chr' || (1 + i % 22) AS c, 700000 * i + 1 AS a, 700000 * i + 5000000 AS b FROM range(200) t(i))"
_CONTIGS = "(SELECT unnest(['chr' || i FOR i IN range(1, 23)] || ['chrX']) AS name)"
_ALL = 18446744073709551616


def _u(x: str) -> str:
    return f"({x})::UHUGEINT"


def _turn(x: str, bits: int, low: str | None = None) -> str:
    """``x`` turned left by ``bits`` of 64, with those that come in taken from ``low``."""
    return f"(({x}) * {_u(str(2**bits))} % {_u(str(_ALL))} + ({low or x}) // {_u(str(2 ** (64 - bits)))})"


def _times(x: str, factor: int) -> str:
    return f"(({x}) * {_u(str(factor))} % {_u(str(_ALL))})"


def _plus(x: str, y: str) -> str:
    return f"((({x}) + ({y})) % {_u(str(_ALL))})"


def _stir(word: str, first: bool) -> str:
    a, b, bits = (0x87C37B91114253D5, 0x4CF5AD432745937F, 31) if first else (0x4CF5AD432745937F, 0x87C37B91114253D5, 33)
    return _times(_turn(_times(word, a), bits), b)


def _word(text: str, at: str, n: int, wide: int, until: str, less: int = 0) -> str:
    """``n`` characters from place ``at`` (1-based) as one number, the first lowest; none from ``until`` on."""
    return _u(" + ".join(f"(CASE WHEN {at} + {i} < {until} THEN greatest(ord(substr({text}, ({at} + {i})::INT, 1)) - {less}, 0) ELSE 0 END)::UHUGEINT * {_u(str(wide**i))}" for i in range(n)))


def murmur_sql(source: str, text: str, seed: str, chars: bool, less: int = 0) -> str:
    """A query over ``source`` (a query with ``id`` and the columns of ``text`` and ``seed``): ``id`` and ``h``, the hash as an unsigned number.

    ``chars`` hashes by UTF-16 units and takes the rest from the start of the text, otherwise
    by bytes, each ``less`` lower.
    """
    size, per, wide = (8, 4, 65536) if chars else (16, 8, 256)
    n, tail = "length(t)", f"CASE WHEN {str(chars).lower()} THEN 1 ELSE full_blocks * {size} + 1 END"
    until = f"CASE WHEN {str(chars).lower()} THEN length(t) % {size} + 1 ELSE length(t) + 1 END"
    a = _plus(_turn(f"xor(x.one, {_stir('y.a', True)})", 27), "x.two")
    a = _plus(_times(a, 5), str(0x52DCE729))
    b = f"xor(x.two, {_stir('y.b', False)})"
    b = _plus(_times(_plus(_turn(b, 31, f"({a})"), a), 5), str(0x38495AB5))
    zero = _u("0")
    block = f"{{'one': {zero}, 'two': {zero}, 'a': {_word('t', f'(k * {size} + 1)', per, wide, f'{n} + 1', less)}, 'b': {_word('t', f'(k * {size} + {per + 1})', per, wide, f'{n} + 1', less)}}}"
    finish = lambda x: f"xor({x}, ({x}) // {_u(str(2**33))})"
    mixed = lambda x: finish(_times(finish(_times(finish(x), 0xFF51AFD7ED558CCD)), 0xC4CEB9FE1A85EC53))
    return f"""(SELECT id, {_plus('fa', 'fb')} AS h FROM (SELECT id, {mixed('one')} AS fa, {mixed('two')} AS fb FROM (
      SELECT id, one, {_plus('one', 'two')} AS two FROM (SELECT id, {_plus('p', 'q')} AS one, q AS two FROM (
      SELECT id, xor(xor(st.one, {_stir('ta', True)}), {_u(n)}) AS p, xor(xor(st.two, {_stir('tb', False)}), {_u(n)}) AS q FROM (
      SELECT id, t, {_word('t', f'({tail})', per, wide, f'({until})', less)} AS ta, {_word('t', f'({tail} + {per})', per, wide, f'({until})', less)} AS tb,
        list_reduce(list_prepend({{'one': {_u('sd')}, 'two': {_u('sd')}, 'a': {zero}, 'b': {zero}}}, [{block} FOR k IN range(0, full_blocks)]), lambda x, y: {{'one': {a}, 'two': {b}, 'a': {zero}, 'b': {zero}}}) AS st
      FROM (SELECT id, {text} AS t, {seed} AS sd, length({text}) // {size} AS full_blocks FROM {source})))))))"""


def _signed(h: str, bits: int = 64) -> str:
    return f"(CASE WHEN {h} >= {_u(str(2 ** (bits - 1)))} THEN ({h})::HUGEINT - {2**bits} ELSE ({h})::HUGEINT END)::BIGINT"


#: The low half of a hash as a signed number, as 64 bits without a sign: the seed of the next.
_SEED = f"(CASE WHEN h % {_u(str(2**32))} >= {_u(str(2**31))} THEN h % {_u(str(2**32))} + {_u(str(2**64 - 2**32))} ELSE h % {_u(str(2**32))} END)"


def _read_keys(reads: str) -> str:
    one = murmur_sql("u", "read_name", "0", True)
    steps = [("h1", one)]
    for i, (column, chars, less) in enumerate((("bases", False, 0), ("quals", False, 33), ("cigar", True, 0)), 2):
        text = f"CASE WHEN {column} = '*' THEN '' ELSE {column} END" if not chars else column
        steps.append((f"h{i}", murmur_sql(f"(SELECT u.*, {_SEED} AS seed FROM u JOIN h{i - 1} USING (id))", text, "seed", chars, less)))
    return reads + ", u AS (SELECT row_number() OVER () AS id, read_name, bases, quals, cigar FROM r WHERE contig IS NULL), " + ", ".join(f"{n} AS {q}" for n, q in steps) + f" SELECT read_name, ({2**31 - 1}::BIGINT << 32) | {_signed(f'(h % {_u(str(2**32))})', 32)} AS key FROM u JOIN h4 USING (id)"


SQL = {
    "qseq_roundtrip": _FRAGMENTS + f"SELECT key, {_FRAGMENT} FROM k",
    "qseq_qc_filter": _FRAGMENTS + "SELECT instrument, run_number, lane, filter_passed FROM f WHERE filter_passed",
    "qseq_line_text": _FRAGMENTS
    + """SELECT concat_ws(chr(9), instrument, run_number, lane, tile, xpos, ypos, coalesce(replace(index_sequence, 'N', '.'), '0'), read, replace(sequence, 'N', '.'),
    array_to_string([chr(ord(x) + 31) FOR x IN string_split(quality, '')], ''), CASE WHEN filter_passed THEN '1' ELSE '0' END) AS value FROM f""",
    "qseq_key_text": _FRAGMENTS + "SELECT key FROM k",
    "fastq_roundtrip": _FRAGMENTS + f"SELECT flowcell_id, control_number, {_FRAGMENT.replace('index_sequence', "coalesce(index_sequence, '') AS index_sequence")} FROM k",
    "fastq_compressed": _FRAGMENTS + f"SELECT flowcell_id, control_number, {_FRAGMENT.replace('index_sequence', "coalesce(index_sequence, '') AS index_sequence")} FROM k",
    "fastq_illumina_id": _FRAGMENTS
    + """SELECT concat_ws(':', instrument, run_number, flowcell_id, lane, tile, xpos, ypos) || ' ' || concat_ws(':', read, CASE WHEN filter_passed THEN 'N' ELSE 'Y' END, control_number, coalesce(index_sequence, '')) AS name,
    instrument, run_number, flowcell_id, lane, tile, xpos, ypos, read, filter_passed, control_number, coalesce(index_sequence, '') AS index_sequence FROM f""",
    "fastq_read_number": """SELECT 'r' || l_orderkey || '.' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '/' || l_linenumber ELSE '' END AS name,
    CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::INT END AS read FROM lineitem""",
    "quality_illumina_to_sanger": "SELECT l_orderkey, l_linenumber, translate(l_orderkey::VARCHAR, '0123456789', '!\"#$%&''()*') AS sanger FROM lineitem",
    "quality_sanger_to_illumina": "SELECT l_orderkey, l_linenumber, translate(l_orderkey::VARCHAR, '0123456789', 'OPQRSTUVWX') AS illumina FROM lineitem",
    "quality_verify": "SELECT l_orderkey, l_linenumber, (instr(l_orderkey::VARCHAR, '7') - 1)::INT AS first_bad FROM lineitem",
    "fragment_equality": """SELECT seq_bases, quality, tile, xpos, ypos, index_sequence, count(*) AS n FROM fragments
    GROUP BY seq_bases, quality, instrument, run_number, flowcell_id, lane, tile, xpos, ypos, read_no, filter_passed, control_number, index_sequence HAVING count(*) > 1""",
    "fragments_qc_filter": "SELECT fragment_id, filter_passed FROM fragments WHERE coalesce(filter_passed, true)",
    "sam_roundtrip": _READS + f"SELECT {_SHOWN} FROM r",
    "sam_stringency": _READS + "SELECT read_name, contig, start FROM r WHERE contig IS NULL OR contig NOT IN ('chr1', 'chr3')",
    "cram_roundtrip": _READS + f"SELECT {_SHOWN} FROM (SELECT * REPLACE (CASE WHEN flags & 4 > 0 THEN 0 ELSE mapq END AS mapq, CASE WHEN flags & 4 > 0 THEN '*' ELSE cigar END AS cigar) FROM r)",
    "cram_intervals": _READS + f"SELECT read_name, contig, start FROM (SELECT * REPLACE (CASE WHEN flags & 4 > 0 THEN start ELSE {_END} END AS \"end\") FROM r) WHERE {_HIT}",
    "reads_of_mixed_formats": _READS + "SELECT read_name, contig, start, CASE WHEN contig IS NOT NULL AND flags & 4 = 0 THEN CASE WHEN start < 1 THEN (start - 1)::BIGINT ELSE (ref_index::BIGINT << 32) | (start - 1) END END AS placed_key FROM r",
    "bai_ranges": _READS + "SELECT read_name, contig, start FROM r",
    "bam_key_ignored": _READS + "SELECT read_name, CASE WHEN start < 1 THEN (start - 1)::BIGINT ELSE (ref_index::BIGINT << 32) | (start - 1) END AS key FROM r WHERE contig IS NOT NULL AND flags % 8 < 4",
    "index_built": _READS + ", n AS (SELECT read_name, row_number() OVER (ORDER BY read_name) AS n FROM r) SELECT read_name FROM n WHERE n = 1 OR n % 64 = 0",
    "index_asked": "SELECT * FROM (VALUES ('merged', true, 0), ('records', true, 0), ('blocks', true, 0)) t(index, has_marks, n_wrong)",
    "starts_guessed": "SELECT * FROM (VALUES ('blocks', 0), ('records', 0), ('ranges', 0)) t(what, n_wrong)",
    "headers_read": f"""SELECT s AS source, 'contig' AS kind, name, 250000000 AS length FROM {_CONTIGS}, (VALUES ('sam'), ('bam'), ('cram'), ('bcf'), ('bytes')) t(s)
    UNION ALL SELECT * FROM (VALUES ('bcf', 'contig', 'chrY', 250000000), ('bcf', 'contig', 'chrM', 20000), ('bcf', 'INFO', 'PR', NULL), ('bcf', 'INFO', 'DP', NULL), ('bcf', 'INFO', 'DB', NULL), ('bcf', 'FILTER', 'q10', NULL),
      ('bcf', 'FILTER', 's50', NULL), ('bcf', 'FORMAT', 'GT', NULL), ('bcf', 'FORMAT', 'GQ', NULL), ('bcf', 'sample', 'S1', NULL), ('bcf', 'sample', 'S2', NULL))
    UNION ALL SELECT 'bytes', 'length', 'all', 12 + length('@HD') + 1 + length('VN:1.6') + 1 + length('SO:unsorted') + 1 + (SELECT sum(length('@SQ') + 1 + length('SN:' || name) + 1 + length('LN:250000000') + 1 + 4 + length(name) + 1 + 4) FROM {_CONTIGS})""",
    "formats_found": """SELECT * FROM (VALUES ('a.bam', 'bam', 'bam', 'none', 'none', 'sam'), ('b.sam', 'sam', 'sam', 'none', 'none', 'sam'), ('c.cram', 'cram', 'cram', 'none', 'none', 'sam'), ('d', 'cram', 'cram', 'none', 'none', 'sam'),
      ('e.sam', 'sam', 'bam', 'none', 'none', 'sam'), ('f.vcf', 'none', 'none', 'vcf', 'vcf', 'sam'), ('g.bcf', 'bam', 'bam', 'bcf', 'bcf', 'sam'), ('h.vcf.gz', 'bam', 'bam', 'vcf', 'vcf', 'sam'), ('i', 'bam', 'bam', 'bcf', 'bcf', 'sam')
      ) t(name, reads_by_name, reads_by_data, variants_by_name, variants_by_data, given)""",
    "refused": """SELECT unnest(['bounded traversal of nothing', 'same encoding', 'unknown encoding', 'pairs together', 'no header', 'no format', 'format not given', 'no interval', 'no boolean', 'genotypes without header', 'unfinished parts', 'unsorted index']) AS what, true AS refused""",
    "interval_texts": """SELECT * FROM (VALUES ('read', 'chr2', 5, 9), ('read', 'scaffold_7', 1, 1), ('read', 'a:b:3', 10, 20), ('read', 'chr2', 8, 30), ('read', 'chr2', 31, 40), ('joined', 'a:b:3', 10, 20), ('joined', 'chr2', 5, 40), ('joined', 'scaffold_7', 1, 1),
      ('text', 'chr2:5-9,scaffold_7:1-1,a:b:3:10-20,chr2:8-30,chr2:31-40', 0, 0), ('empty', '0', 0, 0)) t(what, contig, start, stop)""",
    "boolean_texts": "SELECT * FROM (VALUES ('yes', true), (' True ', true), ('T', true), ('y', true), ('1', true), ('NO', false), ('false', false), ('f', false), ('n', false), ('0', false), ('default', true)) t(word, value)",
    "lines_of_text": "SELECT p_name FROM part",
    "parts_of_a_write": "SELECT i AS place, 'part-0000' || i || '.bam' AS name FROM range(4) t(i)",
    "tool_header": f"""SELECT 0 AS n, concat_ws(chr(9), '@HD', 'VN:1.6', 'SO:queryname') AS line UNION ALL SELECT CASE name WHEN 'chrX' THEN 23 ELSE substr(name, 4)::BIGINT END, concat_ws(chr(9), '@SQ', 'SN:' || name, 'LN:250000000') FROM {_CONTIGS}""",
    "read_unmapped_key": _read_keys(_READS),
    "read_unmapped_key_of_rows": _read_keys(_READS),
    "read_many_intervals": _READS + f""", {_MANY}, w AS (SELECT * REPLACE ("end" + CASE WHEN start % 7 = 0 THEN 60000 ELSE 0 END AS "end") FROM r), x AS (SELECT * FROM w UNION ALL SELECT * FROM w WHERE start % 5 = 0)
    SELECT read_name, contig, start FROM x WHERE EXISTS (SELECT 1 FROM iv WHERE c = contig AND start <= b AND "end" >= a)""",
    "hash_of_text": "WITH u AS (SELECT p_partkey AS id, p_name FROM part) SELECT id AS p_partkey, " + _signed("h") + " AS h FROM " + murmur_sql("u", "p_name", "0", True),
    "hash_of_bytes": "WITH u AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS t FROM customer) SELECT id AS c_custkey, " + _signed("h") + " AS h FROM " + murmur_sql("u", "t", "0", False),
    "bam_roundtrip": _READS + f"SELECT {_SHOWN} FROM r",
    "bam_intervals": _READS + f"SELECT read_name, contig, start FROM (SELECT * REPLACE ({_END} AS \"end\") FROM r) WHERE {_HIT}",
    "bai_intervals": _READS + f"SELECT read_name, contig, start FROM (SELECT * REPLACE ({_END} AS \"end\") FROM r) WHERE {_HIT}",
    "bam_unplaced": _READS + "SELECT read_name, flags FROM r WHERE contig IS NULL",
    "bam_merge": _READS + "SELECT read_name, contig, start FROM r",
    "read_coordinate_key": """SELECT read_id, CASE WHEN start_pos < 1 THEN (start_pos - 1)::BIGINT ELSE (ref_index::BIGINT << 32) | (start_pos - 1)::BIGINT END AS key
    FROM alignments WHERE contig IS NOT NULL AND start_pos IS NOT NULL""",
    "read_intervals": _READS + f'SELECT read_name, contig, start, "end" FROM r WHERE {_HIT}',
    "read_intervals_or_unplaced": _READS + f'SELECT read_name, contig, start, "end" FROM r WHERE contig IS NULL OR {_HIT}',
    "read_interval_join": """SELECT read_id, contig, start_pos FROM alignments a WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND EXISTS (
    SELECT 1 FROM variant_rows v WHERE v.contig = a.contig AND a.start_pos <= v.pos + 20000 AND a.end_pos >= v.pos - 20000)""",
    "read_cigar_span": """SELECT read_id, list_sum([x::INT FOR x IN regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)] || [0])::INT AS span,
    CASE WHEN cigar IS NOT NULL THEN array_to_string([right(x, 1) || left(x, length(x) - 1) FOR x IN regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')], '') END AS steps FROM alignments""",
    "read_tags": """SELECT read_id, substr(t, 1, 2) AS tag, substr(t, 4, 1) AS type, substr(t, 6) AS value
    FROM (SELECT read_id, unnest(string_split(opt_tags, chr(9))) AS t FROM alignments WHERE opt_tags <> '')""",
    "read_sort_order": "SELECT count(*) AS n, 0 AS n_wrong FROM alignments",
    "shuffle_by_name": "SELECT read_name, count(*) AS n_reads, min(start_pos) AS first_start FROM alignments GROUP BY 1",
    "shuffle_by_variant": _VARIANTS + "SELECT contig, id, count(*) AS n FROM v GROUP BY ALL",
    "vcf_roundtrip": _VARIANTS + "SELECT value FROM t",
    "vcf_compressed": _VARIANTS + "SELECT value FROM t",
    "vcf_fields": _VARIANTS
    + """SELECT contig, start, start + length(ref) - 1 AS "end", id, CASE WHEN alt = '.' THEN ref ELSE ref || '/' || replace(alt, ',', '/') END AS alleles, qual, CASE filter WHEN 'PASS' THEN '' WHEN '.' THEN 'none' ELSE filter END AS filters,
    pr, n * 7 % 1000 AS dp, n % 2 = 0 AS db, 2 AS n_genotypes FROM v""",
    "vcf_key": _VARIANTS + "SELECT id, ((CASE pr WHEN 'X' THEN 22 WHEN 'Y' THEN 23 WHEN 'M' THEN 24 ELSE try_cast(pr AS BIGINT) - 1 END)::BIGINT << 32) | (start - 1) AS key FROM v",
    "vcf_intervals": _VARIANTS + "SELECT id, contig, start FROM v WHERE (contig = 'chr1' AND start <= 200000000) OR (contig = 'chr2' AND start <= 90000000 AND start + length(ref) - 1 >= 100)",
    "vcf_many_intervals": _VARIANTS + f", {_MANY} SELECT id, contig, start, 'PR' AS first_key FROM v WHERE EXISTS (SELECT 1 FROM iv WHERE c = contig AND start <= b AND start + length(ref) - 1 >= a)",
    "vcf_genotypes": _VARIANTS + "SELECT id, 'S1' AS sample, gt, gq FROM v UNION ALL SELECT id, 'S2', '1|1', '.' FROM v",
    "vcf_stringency": _VARIANTS + "SELECT contig, start, id FROM v WHERE contig NOT IN ('chr1', 'chr3')",
    "vcf_bgzf_file": _VARIANTS + "SELECT value FROM t",
    "bcf_roundtrip": _VARIANTS + "SELECT value FROM t",
    "fasta_positions": """WITH s AS (SELECT p_partkey // 500 AS g, string_agg(w, '' ORDER BY w) AS s FROM
    (SELECT p_partkey, lpad(translate(p_partkey::VARCHAR, '0123456789', 'ACGTNACGTN'), 8, 'A') AS w FROM part) GROUP BY 1),
    l AS (SELECT 'seq' || g AS d, s, unnest(range(0, (length(s) + 79) // 80)) AS i FROM s)
    SELECT d || (i * 81 + 1) AS key, d AS index_sequence, (i * 81 + 1)::INT AS position, substr(s, (i * 80 + 1)::INT, 80) AS sequence FROM l""",
    "virtual_offset": """SELECT virtual_offset, virtual_offset >> 16 AS block, virtual_offset & 65535 AS inside, virtual_offset + (1000::BIGINT << 16) AS shifted,
    CASE WHEN (virtual_offset + 70000) >> 16 = virtual_offset >> 16 THEN 70000 ELSE ((virtual_offset + 70000) >> 16) - (virtual_offset >> 16) END AS length FROM bam_offsets""",
    "split_index": """WITH r AS (SELECT DISTINCT bam_id, virtual_offset, CASE WHEN granularity > 0 THEN granularity ELSE 4096 END AS g
    FROM bam_offsets JOIN bam_files USING (bam_id) WHERE virtual_offset <> file_size << 16),
    n AS (SELECT *, row_number() OVER (PARTITION BY bam_id ORDER BY virtual_offset) AS n FROM r)
    SELECT bam_id, virtual_offset FROM n WHERE n = 1 OR n % g = 0""",
}

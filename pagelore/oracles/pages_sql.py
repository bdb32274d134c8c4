"""Check statements for the page, table and chunk queries."""

from __future__ import annotations

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C, add_chunks
from pagelore.operators.pages import BLOCK_END, ENTITIES, META_FIELDS

_html = "html"
for pattern, repl in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
                      (r"(?s)<!--.*?-->", ""), (BLOCK_END, "\n"), (r"<[^>]+>", " ")):
    _html = dk.sub(_html, pattern, repl)
for entity, char in ENTITIES:
    _html = f"replace({_html}, {dk.q(entity)}, {dk.q(char)})"

C.add("web_v", f"""
SELECT page_id AS document_id, 1::BIGINT AS page_number, html,
       {dk.let(dk.clean_text(_html), dk.remove_header_footer)} AS text FROM pages""")

_meta = ", ".join(
    f"regexp_extract(html, {dk.q(f'(?is)<meta[^>]*name={chr(34)}{m}{chr(34)}[^>]*content={chr(34)}([^{chr(34)}]*){chr(34)}')}, 1) AS {m}"
    for m in META_FIELDS)


def markdown(h: str, rows: str) -> str:
    def line(cells: str) -> str:
        return f"('| ' || array_to_string({cells}, ' | ') || ' |')"

    def fitted(r: str) -> str:
        return line(f"list_resize({r}, len({h}), '')")

    dashes = dk.tmap(h, lambda _: "'---'")
    return (f"array_to_string(list_concat(CASE WHEN len({h}) > 0 THEN [{line(h)}, {line(dashes)}] ELSE [] END, "
            f"{dk.tmap(rows, fitted)}), chr(10))")


def plain_text(h: str, rows: str, md: str) -> str:
    top = f"array_to_string({h}, ' | ')"
    body = dk.tmap(rows, lambda r: f"array_to_string({r}, ' | ')")
    return (f"CASE WHEN coalesce({md}, '') <> '' THEN {md} ELSE array_to_string(list_concat("
            f"CASE WHEN len({h}) > 0 THEN [{top}, repeat('-', length({top}))] ELSE [] END, {body}), chr(10)) END")


def rows_out(rows: str) -> str:
    x = dk.tmap(rows, lambda r: f"array_to_string({r}, ' ~ ')")
    return f"array_to_string({x}, chr(10))"


TABLE_COLUMNS = f"array_to_string(headers, ' ~ ') AS headers, {rows_out('rows')} AS rows, markdown"

# column-like lines by gaps and islands over exploded lines
_cols = f"regexp_split_to_array({dk.strip('line')}, {dk.q(fv.S + '{2,}|' + chr(9))})"
C.add("sheet_lines", f"""
SELECT document_id, page_number, pos, {_cols} AS cols FROM (
  SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM sheets_v)""", "sheets_v")
C.add("sheet_blocks", """
SELECT document_id, page_number, min(pos) AS start_pos, list(cols ORDER BY pos) AS block FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) AS island
  FROM sheet_lines WHERE len(cols) >= 3)
GROUP BY document_id, page_number, island HAVING count(*) >= 3""", "sheet_lines")
C.add("sheet_tables", f"""
SELECT *, {markdown('headers', 'rows')} AS markdown FROM (
  SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY start_pos) - 1 AS table_index,
         block[1] AS headers, block[2:] AS rows FROM sheet_blocks)""", "sheet_blocks")

_trimmed = dk.tmap("cells", lambda r: dk.tmap(r, dk.strip))
_body = dk.tfilter("trimmed[2:]", lambda r: f"len({dk.tfilter(r, lambda x: f'{x} <> {dk.q(str())}')}) > 0")
C.add("cell_tables", f"""
SELECT *, {markdown('headers', 'rows')} AS markdown FROM (
  SELECT document_id, page_number, table_index, flavour, trimmed[1] AS headers, {_body} AS rows
  FROM (SELECT *, {_trimmed} AS trimmed FROM grids_v))""", "grids_v")
C.add("best_tables", """
SELECT * FROM cell_tables WHERE flavour = 'lattice'
   OR document_id NOT IN (SELECT document_id FROM cell_tables WHERE flavour = 'lattice')""", "cell_tables")


def cleaned(name: str) -> str:
    full = dk.tfilter("rows", lambda r: f"NOT (len({dk.tfilter(r, lambda x: dk.strip(x) + ' <> ' + dk.q(''))}) < len({r}) * 0.3)")
    rows = dk.tmap(full, lambda r: dk.tmap(r, dk.clean_text))
    return (f"SELECT * EXCLUDE (rows, markdown), cleaned AS rows, {markdown('headers', 'cleaned')} AS markdown "
            f"FROM (SELECT *, {rows} AS cleaned FROM {name})")


C.add("clean_best", cleaned("best_tables"), "best_tables")
C.add("page_tables", f"""
SELECT document_id, page_number, string_agg(chr(10) || {plain_text('headers', 'rows', 'markdown')}, '' ORDER BY table_index) AS table_text
FROM clean_best JOIN page_counts USING (document_id) WHERE page_count <= {fv.MAX_PAGES_FOR_TABLES} GROUP BY 1, 2""",
      "clean_best", "page_counts")


def ocr(where: str) -> str:
    return (f"SELECT document_id, page_number, {dk.clean_text('t')} AS text FROM (SELECT document_id, page_number, "
            f"string_agg(text, chr(10) ORDER BY pos) AS t FROM detections_v WHERE confidence > 0.5 AND {where} GROUP BY 1, 2)")


C.add("ocr_primary", ocr("engine = 'primary'"), "detections_v")
C.add("ocr_second", ocr("engine = 'fallback'"), "detections_v")
C.add("merged_all", f"""
SELECT document_id, page_number, concat_ws(chr(10) || chr(10), CASE WHEN t THEN text WHEN o THEN ocr_text END,
         CASE WHEN tb THEN chr(10) || chr(10) || '[TABLE]' || chr(10) || table_text || chr(10) || '[/TABLE]' END) AS merged_text,
       concat_ws(' ~ ', CASE WHEN t THEN 'text' END, CASE WHEN o THEN 'ocr' END, CASE WHEN tb THEN 'table' END) AS source_types
FROM (SELECT d.document_id, d.page_number, d.text, o.text AS ocr_text, p.table_text, {dk.strip('d.text')} <> '' AS t,
             coalesce({dk.strip('o.text')}, '') <> '' AS o, coalesce({dk.strip('p.table_text')}, '') <> '' AS tb
      FROM digital_v d LEFT JOIN ocr_primary o USING (document_id, page_number)
      LEFT JOIN page_tables p USING (document_id, page_number))""", "digital_v", "ocr_primary", "page_tables")

add_chunks("tab", "(SELECT * FROM page_tables WHERE length(table_text) > 1024)", "table_text", ("page_tables",))

_tabular = dk.tfilter("lines", lambda x: f"(len(string_split({x}, '  ')) >= 3 OR contains({x}, chr(9)))")

SQL = {
    "extract_pages": C.sql("SELECT document_id, page_number, text, regexp_matches(html, '(?i)<img') AS has_images, "
                           "length(text) AS char_count, 'text' AS source_type FROM web_v", "web_v"),
    "extract_metadata": f"SELECT page_id AS document_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, "
                        f"regexp_extract(html, '(?is)<html[^>]*lang=\"([^\"]*)\"', 1) AS language, {_meta}, "
                        f"1::BIGINT AS page_count FROM pages",
    "page_has_tables": C.sql(f"SELECT document_id, page_number, len({_tabular}) > len(lines) * 0.3 AS has_tables FROM ("
                             f"SELECT *, string_split({dk.strip('text')}, chr(10)) AS lines FROM sheets_v)", "sheets_v"),
    "page_stats": C.sql("SELECT document_id, page_number, text, char_count FROM digital_v", "digital_v"),
    "needs_ocr": C.sql("SELECT document_id, bool_or(has_images AND char_count < 50) AS needs_ocr, "
                       "sum(char_count) > 100 AS has_digital_text FROM digital_v GROUP BY 1", "digital_v"),
    "ocr_candidates": C.sql(
        "SELECT document_id, page_number, char_count FROM digital_v WHERE char_count < 100 AND document_id IN "
        "(SELECT document_id FROM digital_v WHERE has_images AND char_count < 50)", "digital_v"),
    "ocr_assemble": C.sql(ocr("true"), "detections_v"),
    "ocr_fallback": C.sql(f"""SELECT p.document_id, p.page_number, {dk.clean_text("coalesce(CASE WHEN " + dk.strip('a.text') + " <> '' THEN a.text END, b.text, '')")} AS text
FROM pages_v p LEFT JOIN ocr_primary a USING (document_id, page_number) LEFT JOIN ocr_second b USING (document_id, page_number)""",
                          "pages_v", "ocr_primary", "ocr_second"),
    "tables_from_text": C.sql(f"SELECT document_id, page_number, table_index, {TABLE_COLUMNS} FROM sheet_tables", "sheet_tables"),
    "table_flavour_fallback": C.sql("SELECT document_id, page_number, flavour, len(cells) AS n_rows FROM grids_v g WHERE flavour = 'lattice' "
                                    "OR NOT EXISTS (SELECT 1 FROM grids_v h WHERE h.document_id = g.document_id AND h.flavour = 'lattice')",
                                    "grids_v"),
    "table_from_cells": C.sql(f"SELECT document_id, page_number, flavour, {TABLE_COLUMNS} FROM cell_tables", "cell_tables"),
    "table_to_markdown": C.sql("SELECT document_id, table_index, markdown FROM sheet_tables", "sheet_tables"),
    "table_to_text": C.sql(f"SELECT document_id, flavour, {plain_text('headers', 'rows', 'md')} AS table_text FROM ("
                           f"SELECT *, CASE WHEN document_id % 2 = 0 THEN markdown END AS md FROM cell_tables)", "cell_tables"),
    "clean_tables": C.sql(f"SELECT document_id, page_number, table_index, {TABLE_COLUMNS} FROM ({cleaned('sheet_tables')})", "sheet_tables"),
    "tables_by_page": C.sql("SELECT document_id, page_number, table_text FROM page_tables", "page_tables"),
    "merge_pages": C.sql("SELECT * FROM merged_all", "merged_all"),
    "full_text": C.sql(f"""
SELECT document_id, part, string_agg(block, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM (
  SELECT *, (coalesce(sum(length(block)) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000)::BIGINT AS part
  FROM (SELECT document_id, page_number, '[Page ' || page_number || ']' || chr(10) || merged_text AS block FROM merged_all WHERE {dk.strip('merged_text')} <> ''))
GROUP BY 1, 2""", "merged_all"),
    "document_status": C.sql("""
SELECT d.id AS document_id, coalesce(count(m.page_number), 0) AS page_count, CAST(coalesce(sum(length(m.merged_text)), 0) AS BIGINT) AS total_chars,
       CASE WHEN d.status = 'failed' THEN 'failed' ELSE 'processed' END AS status,
       CASE WHEN d.status = 'failed' THEN 'Extraction error: ' || d.original_name END AS error_message
FROM docs_v d LEFT JOIN merged_all m ON m.document_id = d.id GROUP BY d.id, d.status, d.original_name""", "docs_v", "merged_all"),
    "single_page_text": C.sql(f"""SELECT r.document_id, r.page_number, CASE WHEN p.raw_text IS NOT NULL THEN {dk.clean_text('p.raw_text')} END AS text
FROM (SELECT doc_id AS document_id, unnest([1, doc_id % 5 + 2])::BIGINT AS page_number FROM documents) r
LEFT JOIN pages_v p USING (document_id, page_number)""", "pages_v"),
    "page_count": C.sql("SELECT d.doc_id AS document_id, coalesce(page_count, 0) AS page_count FROM documents d "
                        "LEFT JOIN page_counts p ON p.document_id = d.doc_id", "page_counts"),
    "chunk_pages": C.sql("SELECT 'doc' || document_id || '_p' || page_number || '_c' || chunk_index AS chunk_id, document_id, page_number, "
                         "chunk_index, content, length(content) AS char_count FROM raw_page_chunks", "raw_page_chunks"),
    "chunk_documents": C.sql("SELECT * FROM chunks_v", "chunks_v"),
    "chunk_tables": C.sql("""
SELECT 'doc' || document_id || '_p' || page_number || '_table' AS chunk_id, document_id, page_number, 0::BIGINT AS chunk_index,
       'table' AS source_type, table_text AS content, length(table_text) AS char_count FROM page_tables WHERE length(table_text) <= 1024
UNION ALL
SELECT 'doc' || document_id || '_p' || page_number || '_c' || chunk_index, document_id, page_number, chunk_index, 'table', content, length(content)
FROM tab_page_chunks""", "page_tables", "tab_page_chunks"),
}

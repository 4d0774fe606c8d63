"""DuckDB SQL by query name, over the same tables. Written apart from the DataFrame code."""

from __future__ import annotations

from terraquill import vocab


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(terms) -> str:
    return "[" + ", ".join(map(_q, terms)) + "]"


KW, SP, ST, CLS = (_list(x) for x in (vocab.AERIAL_KEYWORDS, vocab.SPATIAL_TERMS, vocab.STRUCTURE_TERMS, vocab.DETECT_CLASSES))
MODELS = "(VALUES " + ", ".join(f"({i}, {_q(m.key)}, {_q(m.name)}, {m.memory_gb}::DOUBLE)" for i, m in enumerate(vocab.MODELS)) + ") m(model_ord, model, model_name, memory_gb)"

CAP = f"""cap AS (SELECT doc_id AS image_id, doc_id % 4 AS model_ord, {_list(m.key for m in vocab.MODELS)}[doc_id % 4 + 1] AS model_key,
 concat('The image shows ', doc_id % 7, ' ', {KW}[doc_id % 28 + 1], ' near the ', {SP}[doc_id % 10 + 1], ' and ', doc_id % 5, ' ', {KW}[(doc_id * 5 + 3) % 28 + 1], '. ', text) AS caption,
 n_chars / 1000.0::DOUBLE AS inference_time, doc_id % 17 = 3 AS is_error FROM documents)"""
DET = f"""det AS (SELECT l_orderkey // 16 AS image_id, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_idx,
 {CLS}[l_partkey % 32 + 1] AS label, l_quantity / 50.0::DOUBLE AS score, (l_partkey * 37) % 1024 AS center_x, (l_suppkey * 53) % 1024 AS center_y,
 CASE WHEN l_discount = 0 THEN 0::BIGINT ELSE floor(l_extendedprice * 4)::BIGINT END AS area FROM lineitem),
sure AS (SELECT * FROM det WHERE score >= 0.25)"""
_HITS = "len(list_filter({terms}, lambda t: contains(lower(caption), t)))"
QUALITY = f"""counted AS (SELECT *, len(regexp_extract_all(caption, '\\S+')) AS word_count, len(regexp_extract_all(caption, '\\b\\d+\\b')) AS number_count, {_HITS.format(terms=SP)} AS sp, {_HITS.format(terms=ST)} AS st, {_HITS.format(terms=KW)} AS keyword_count FROM cap),
parts AS (SELECT *, CASE WHEN word_count < 20 THEN 0.3::DOUBLE WHEN word_count < 50 THEN 0.6::DOUBLE WHEN word_count < 150 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS length, least(number_count / 3.0::DOUBLE, 1.0::DOUBLE) AS quantification, least(sp / 3.0::DOUBLE, 1.0::DOUBLE) AS spatial, least(st / 4.0::DOUBLE, 1.0::DOUBLE) AS structures FROM counted),
quality AS (SELECT *, length * 0.2::DOUBLE + quantification * 0.3::DOUBLE + spatial * 0.25::DOUBLE + structures * 0.25::DOUBLE AS overall FROM parts)"""
OBS = """obs AS (SELECT image_id, model_key, is_error, CASE WHEN is_error THEN 0.0::DOUBLE ELSE inference_time END AS inference_time, CASE WHEN is_error THEN 0 ELSE keyword_count END AS keyword_count, word_count,
 CASE WHEN NOT is_error THEN length END AS length, CASE WHEN NOT is_error THEN quantification END AS quantification, CASE WHEN NOT is_error THEN spatial END AS spatial, CASE WHEN NOT is_error THEN structures END AS structures, CASE WHEN is_error THEN 0.0::DOUBLE ELSE overall END AS overall FROM quality)"""


def _summary(where: str = "true") -> str:
    return f"""WITH {CAP}, {QUALITY}, {OBS}, means AS (SELECT model_key, avg(inference_time) AS t, avg(overall) AS q, avg(keyword_count) AS k FROM obs WHERE {where} GROUP BY model_key),
summary AS (SELECT CAST(model_ord AS BIGINT) AS model_ord, model, model_name, memory_gb, round(t, 9) AS avg_time_s, round(q, 9) AS avg_quality, round(k, 9) AS avg_keywords, round(q * 0.5::DOUBLE + k / 10.0::DOUBLE * 0.3::DOUBLE + 1.0::DOUBLE / (t + 1.0::DOUBLE) * 0.2::DOUBLE, 9) AS combined_score FROM means JOIN {MODELS} ON model = model_key)"""


GRID = f"{_list(vocab.POSITIONS)}[CAST(least(floor(center_y / (1024 / 3.0::DOUBLE)), 2) * 3 + least(floor(center_x / (1024 / 3.0::DOUBLE)), 2) + 1 AS INTEGER)]"
RELATIVE = "area / (1024 * 1024)::DOUBLE"
SIZE = f"CASE WHEN {RELATIVE} > 0.15 THEN 'large' WHEN {RELATIVE} > 0.05 THEN 'medium' ELSE 'small' END"
COUNTS = "counts AS (SELECT image_id, label, count(*) AS n, min(det_idx) AS ord FROM sure GROUP BY image_id, label)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, ord) AS rank FROM counts)"
TEXTS = "texts AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS total, string_agg(n || ' ' || label, ', ' ORDER BY ord) AS counts_text, string_agg(n || ' ' || label, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS summary FROM ranked GROUP BY image_id)"
LOC = f"loc AS (SELECT image_id, det_idx, label AS object, {GRID} AS position, center_x, center_y, area, {RELATIVE} AS relative_size, {SIZE} AS size_description FROM sure WHERE area > 0)"
POS = "pos AS (SELECT image_id, position, object, count(*) AS n, min(det_idx) AS ord FROM loc GROUP BY image_id, position, object)"
DESC = """groups AS (SELECT image_id, position, min(ord) AS ord, CASE WHEN count(*) = 1 AND min(n) = 1 THEN min(object) || ' in ' || position
 ELSE string_agg(n || ' ' || object || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY ord) || ' in ' || position END AS text FROM pos GROUP BY image_id, position),
numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS k FROM groups),
descriptions AS (SELECT image_id, string_agg(text, '; ' ORDER BY ord) AS spatial_description FROM numbered WHERE k <= 5 GROUP BY image_id)"""
ALL = f"{DET}, {COUNTS}, {RANKED}, {TEXTS}, {LOC}, {POS}, {DESC}"
ENHANCED = "enhanced AS (SELECT image_id, total, counts_text, spatial_description, summary || CASE WHEN coalesce(spatial_description, '') <> '' THEN '. Spatial layout: ' || spatial_description ELSE '' END AS summary FROM texts LEFT JOIN descriptions USING (image_id))"
_EXTRACT = "CASE WHEN contains(summary, 'Spatial layout:') THEN regexp_replace(list_extract(string_split(summary, 'Spatial layout:'), -1), '^\\s+|\\s+$', '', 'g') ELSE '' END"
_CLEAN = "replace(replace(replace(replace(regexp_replace(caption, '^\\s+|\\s+$', '', 'g'), 'The image shows ', ''), 'The scene shows ', ''), 'This is ', ''), 'It is ', '')"


def _prompts(t: vocab.Template) -> str:
    return f"""WITH {CAP}, {ALL}, {ENHANCED}, joined AS (SELECT cap.image_id, {_CLEAN} AS caption, coalesce(total, 0) AS total, coalesce(counts_text, '') AS counts_text, spatial_description, coalesce(summary, '') AS summary FROM cap LEFT JOIN enhanced USING (image_id)),
laid AS (SELECT *, {_EXTRACT} AS layout FROM joined),
prompts AS (SELECT *, CASE WHEN counts_text = '' OR total = 0 THEN 'Aerial view: ' || caption ELSE {_q(t.lead)} || lower(caption) || {_q(t.counts)} || counts_text || CASE WHEN layout <> '' THEN {_q(t.layout)} || layout WHEN summary <> '' THEN '. ' || summary ELSE '' END || {_q(t.suffix)} END AS prompt FROM laid)"""


_MISSING = f"""WITH {CAP}, {ALL}, {ENHANCED}, facts AS (SELECT *, CASE WHEN image_id % 7 <> 2 THEN summary END AS said FROM enhanced),
joined AS (SELECT cap.image_id, CASE WHEN cap.image_id % 11 <> 5 THEN {_CLEAN} END AS caption, coalesce(total, 0) AS total, CASE WHEN cap.image_id % 13 <> 4 THEN coalesce(counts_text, '') END AS counts_text, CASE WHEN cap.image_id % 7 = 2 THEN NULL ELSE coalesce(said, '') END AS summary FROM cap LEFT JOIN facts USING (image_id)),
laid AS (SELECT *, {_EXTRACT} AS layout, 'Aerial view: ' || coalesce(caption, 'None') AS plain FROM joined),
prompts AS (SELECT *, CASE WHEN counts_text IS NULL THEN plain || CASE WHEN coalesce(summary, '') <> '' THEN ', ' || summary ELSE '' END WHEN counts_text = '' OR total = 0 THEN plain WHEN caption IS NULL OR summary IS NULL THEN plain || CASE WHEN coalesce(summary, '') <> '' THEN ', ' || summary ELSE '' END
 ELSE {_q(vocab.PRODUCTION.lead)} || lower(caption) || {_q(vocab.PRODUCTION.counts)} || counts_text || CASE WHEN layout <> '' THEN {_q(vocab.PRODUCTION.layout)} || layout WHEN summary <> '' THEN '. ' || summary ELSE '' END || {_q(vocab.PRODUCTION.suffix)} END AS prompt FROM laid)
SELECT image_id, prompt, len(regexp_extract_all(prompt, '\\S+')) AS word_count, CAST(floor(len(regexp_extract_all(prompt, '\\S+')) * 1.3::DOUBLE) AS BIGINT) AS est_tokens FROM prompts"""


def _prompt_query(t: vocab.Template) -> str:
    return f"{_prompts(t)} SELECT image_id, prompt, len(regexp_extract_all(prompt, '\\S+')) AS word_count, CAST(floor(len(regexp_extract_all(prompt, '\\S+')) * 1.3::DOUBLE) AS BIGINT) AS est_tokens FROM prompts"


_MODEL_JSON = ", ".join(f"{k} := {_q(v)}" for k, v in vocab.STAGE_MODELS.items())
_PATH = "regexp_replace(url, '[?#].*$', '')"
_FILE = f"list_extract(string_split({_PATH}, '/'), -1)"

_IMAGES = """bytes AS (SELECT page_id, encode(coalesce(html, '')) AS data, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 3 END AS c FROM pages WHERE page_id IS NOT NULL),
sized AS (SELECT *, (octet_length(data) + c - 1) // c AS n, octet_length(data) = 0 OR page_id % 16 = 3 AS broken FROM bytes),
wide AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS w FROM sized),
images AS (SELECT *, concat('page_', page_id) AS image_name, CASE WHEN NOT broken THEN (n + w - 1) // w END AS h FROM wide)"""

ORACLE: dict[str, str] = {
    "caption_quality": f"WITH {CAP}, {QUALITY} SELECT image_id, word_count, number_count, round(length, 9) AS length, round(quantification, 9) AS quantification, round(spatial, 9) AS spatial, round(structures, 9) AS structures, round(overall, 9) AS overall FROM quality",
    "keyword_hits": f"WITH {CAP}, {QUALITY} SELECT image_id, keyword_count FROM quality",
    "keyword_list": f"WITH {CAP} SELECT image_id, array_to_string(list_filter({KW}, lambda t: contains(lower(caption), t)), ',') AS keywords FROM cap",
    "vocab_match": f"WITH {CAP}, hits AS (SELECT unnest(list_filter({KW}, lambda t: contains(lower(caption), t))) AS term FROM cap) SELECT term, count(*) AS n_captions FROM hits GROUP BY term",
    "word_counts": "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS word_count FROM documents",
    "token_budget": "WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS word_count FROM documents) SELECT doc_id, word_count, CAST(floor(word_count * 1.3::DOUBLE) AS BIGINT) AS est_tokens, floor(word_count * 1.3::DOUBLE) <= 512 AS fits FROM w",
    "quantification": f"WITH {CAP}, {QUALITY} SELECT image_id, number_count, round(quantification, 9) AS quantification FROM quality",
    "clean_captions": f"WITH {CAP} SELECT image_id, {_CLEAN} AS caption FROM cap",
    "caption_preview": f"WITH {CAP} SELECT image_id, caption[:70] || '...' AS first_70, caption[:100] || '...' AS first_100, caption[:150] || '...' AS first_150, caption[:200] || '...' AS first_200, length(caption) AS n_chars FROM cap",
    "error_captions": f"WITH {CAP} SELECT image_id, '[Generation failed: ' || caption[:50] || ']' AS failed, 'ERROR: ' || caption AS error FROM cap WHERE is_error",
    "output_paths": f"WITH {CAP} SELECT image_id, concat('outputs/images/image_', image_id, '_upscaled.png') AS upscaled, concat('outputs/images/image_', image_id, '_generated.png') AS generated, concat('outputs/images/image_', image_id, '_generated_control.png') AS control, concat('outputs/metadata/image_', image_id, '.json') AS metadata FROM cap",
    "class_prompt": f"WITH {DET}, there AS (SELECT list(DISTINCT label) AS labels FROM sure) SELECT array_to_string(list_filter({CLS}, lambda c: list_contains(labels, c)), ' . ') AS class_prompt FROM there",
    "assistant_reply": "WITH r AS (SELECT conv_id, string_agg(concat_ws(' ', role, text), ' ' ORDER BY turn, concat_ws(' ', role, text)) AS response FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN contains(lower(response), 'assistant') THEN regexp_replace(list_extract(string_split(response, 'assistant'), -1), '^\\s+|\\s+$', '', 'g') ELSE response END AS reply FROM r",
    "image_name": f"SELECT page_id, {_FILE} AS file_name, CASE WHEN regexp_matches({_FILE}, '.\\.[^.]*$') THEN regexp_replace({_FILE}, '\\.[^.]*$', '') ELSE {_FILE} END AS image_name FROM pages",
    "chat_messages": "SELECT doc_id AS image_id, 2::BIGINT AS n_parts, 'user' AS role, concat('image_', doc_id, '.png') AS image, 'Describe this aerial image.' AS text FROM documents",
    "observations": f"WITH {CAP}, {QUALITY}, {OBS} SELECT image_id, model_key, is_error, round(inference_time, 9) AS inference_time, keyword_count, round(length, 9) AS length, round(quantification, 9) AS quantification, round(spatial, 9) AS spatial, round(structures, 9) AS structures, round(overall, 9) AS overall FROM obs",
    "benchmark_summary": _summary() + " SELECT * FROM summary",
    "benchmark_summary_failed": _summary("model_key <> 'internvl2_4b'") + " SELECT * FROM summary",
    "benchmark_summary_good_rows": _summary("NOT is_error") + " SELECT * FROM summary",
    "model_ranking": _summary() + " SELECT row_number() OVER (ORDER BY combined_score DESC, model_ord) AS rank, model, combined_score FROM summary",
    "best_model": _summary() + " SELECT model, model_name, combined_score FROM summary ORDER BY combined_score DESC, model_ord LIMIT 1",
    "model_image_grid": f"SELECT CAST(model_ord AS BIGINT) AS model_ord, model AS model_key, doc_id AS image_id FROM documents, {MODELS}",
    "benchmark_summary_merged": _summary() + " SELECT * FROM summary",
    "model_results": f"WITH {CAP}, {QUALITY}, {OBS}, placed AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY image_id) - 1 AS pos FROM obs) SELECT model_key, pos // 1000 AS chunk_no, min(pos) AS first, count(*) AS n_images, string_agg(concat_ws(':', image_id, keyword_count, word_count), ',' ORDER BY image_id) AS results FROM placed GROUP BY model_key, pos // 1000",
    "vocabulary_terms": "WITH terms AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark), long AS (SELECT list(term) AS l FROM terms WHERE length(term) >= 6), hits AS (SELECT doc_id, list_filter(l, lambda t: contains(lower(text), t)) AS h FROM documents, long) SELECT doc_id, CAST(len(h) AS BIGINT) AS n_terms, list_min(h) AS first_term FROM hits",
    "run_summary": f"WITH {CAP} SELECT CAST(sum(CASE WHEN is_error THEN 0 ELSE 1 END) AS BIGINT) AS successful, count(*) AS total FROM cap",
    "filter_detections": f"WITH {DET} SELECT image_id, det_idx, label, round(score, 9) AS score FROM sure",
    "detections_long": f"WITH {DET} SELECT image_id, det_idx - 1 AS det_idx, label, round(score, 9) AS score, center_x::DOUBLE AS x, center_y::DOUBLE AS y FROM det",
    "detection_counts": f"WITH {DET}, {COUNTS} SELECT * FROM counts",
    "detection_totals": f"WITH {DET} SELECT image_id, count(*) AS total FROM sure GROUP BY image_id",
    "top3_labels": f"WITH {DET}, {COUNTS}, {RANKED} SELECT image_id, rank, label, n FROM ranked WHERE rank <= 3",
    "counts_text": f"WITH {DET}, {COUNTS}, {RANKED}, {TEXTS} SELECT image_id, counts_text FROM texts",
    "detection_summary": f"WITH {DET}, {COUNTS}, {RANKED}, {TEXTS} SELECT image_id, summary, total FROM texts",
    "detection_counts_full": f"WITH {DET}, {COUNTS}, {RANKED}, {TEXTS} SELECT doc_id AS image_id, coalesce(total, 0) AS total, coalesce(counts_text, '') AS counts_text, coalesce(summary, '') AS summary FROM documents LEFT JOIN texts ON doc_id = image_id",
    "grid_position": f"WITH {DET} SELECT image_id, det_idx, {GRID} AS position FROM sure",
    "size_class": f"WITH {DET} SELECT image_id, det_idx, round({RELATIVE}, 9) AS relative_size, {SIZE} AS size_description FROM sure",
    "localize": f"WITH {DET}, {LOC} SELECT image_id, det_idx, object, position, center_x, center_y, area, round(relative_size, 9) AS relative_size, size_description FROM loc",
    "unlocalized": f"WITH {DET} SELECT image_id, det_idx, label FROM sure WHERE area = 0",
    "position_counts": f"WITH {DET}, {LOC}, {POS} SELECT * FROM pos",
    "spatial_description": f"WITH {DET}, {LOC}, {POS}, {DESC} SELECT * FROM descriptions",
    "mask_geometry": f"WITH {DET}, wide AS (SELECT image_id, det_idx, center_y, unnest(range(center_x, center_x + det_idx % 3 + 1)) AS x FROM det), pixels AS (SELECT image_id, det_idx, x, unnest(range(center_y, center_y + det_idx % 3 + 1)) AS y FROM wide WHERE (x + det_idx) % 4 <> 0) SELECT CAST(image_id AS VARCHAR) AS image_name, det_idx, CAST(floor(avg(x)) AS BIGINT) AS center_x, CAST(floor(avg(y)) AS BIGINT) AS center_y, count(*) AS area FROM pixels GROUP BY image_id, det_idx",
    "enhanced_summary": f"WITH {ALL}, {ENHANCED} SELECT image_id, summary FROM enhanced",
    "spatial_extract": f"WITH {ALL}, {ENHANCED} SELECT image_id, {_EXTRACT} AS layout FROM enhanced",
    "combine_prompt": _prompt_query(vocab.PRODUCTION),
    "combine_prompt_missing": _MISSING,
    "combine_prompt_stored": _prompt_query(vocab.PRODUCTION),
    "combine_prompt_v1": _prompt_query(vocab.FIRST_VERSION),
    "prompt_checks": f"{_prompts(vocab.PRODUCTION)} SELECT bool_and(contains(prompt, counts_text)) AS counts_kept, bool_and(contains(prompt, coalesce(spatial_description, ''))) AS layout_kept, bool_and(starts_with(prompt, {_q(vocab.PRODUCTION.lead)})) AS lead_kept, count(*) AS n_prompts FROM prompts WHERE total > 0",
    "metadata_json": f"WITH {CAP} SELECT image_id, CAST(to_json(struct_pack(source := concat('in/image_', image_id, '.jpg'), output := concat('outputs/images/image_', image_id, '_generated.png'), output_caption := concat('caption of image_', image_id), generation_prompt := concat('Aerial view: image_', image_id), models := struct_pack({_MODEL_JSON}))) AS VARCHAR) AS metadata FROM cap WHERE NOT is_error",
    "limit_images": "SELECT doc_id, concat('image_', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END) AS path FROM documents ORDER BY doc_id % 2, path LIMIT 5",
    "union_sources": "SELECT concat('d', doc_id, '.jpg') AS path, 0 AS ord FROM documents UNION ALL SELECT concat('p', page_id, '.png'), 1 FROM pages",
    "number_format": "SELECT l_orderkey, l_linenumber, printf('%.1f', l_quantity) AS one, printf('%.2f', l_quantity / 4 + 0.001::DOUBLE) AS two, l_partkey::DOUBLE AS gib FROM lineitem",
    "token_trim": """WITH ids AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS said FROM documents)
SELECT doc_id, array_to_string(said[4:], ',') AS said, least(len(said), 3)::BIGINT AS first, doc_id AS last FROM ids""",
    "scan_images": f"WITH {_IMAGES} SELECT image_name, CASE WHEN broken THEN 'jpg' ELSE 'png' END AS ext, CASE WHEN broken THEN 0 ELSE 1 END AS ord FROM images",
    "decode_images": f"""WITH {_IMAGES} SELECT image_name, CASE WHEN broken THEN -1 ELSE h END::INTEGER AS height, CASE WHEN broken THEN -1 ELSE w END::INTEGER AS width, CASE WHEN broken THEN -1 ELSE c END::INTEGER AS n_channels,
 CASE WHEN broken THEN -1 WHEN c = 1 THEN 0 ELSE 16 END AS mode, sha256(CASE WHEN broken THEN ''::BLOB ELSE data || repeat('\\x00'::BLOB, h * w * c - octet_length(data)) END) AS pixels_sha256 FROM images""",
}

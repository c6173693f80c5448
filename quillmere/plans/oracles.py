"""SQL counterparts of the catalogue, for DuckDB over the same tables."""

from __future__ import annotations

from quillmere.operators.text_index import PLAIN

ASCII = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: Letters and digits of any script, Latin letters without their diacritics, marks that stand apart dropped.
ANY = rf"regexp_extract_all(translate(regexp_replace(lower(translate(text, '{''.join(PLAIN)}', '{''.join(PLAIN.values())}')), '\p{{Mn}}', '', 'g'), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+')"


def bm25(tok: str) -> str:
    return f"""c AS (SELECT doc_id, source, len(list_filter({tok}, lambda x: x = 'the')) f0, len(list_filter({tok}, lambda x: x = 'and')) f1, len({tok}) dl FROM documents),
st AS (SELECT count(*) n, avg(dl) a, count(*) FILTER (f0 > 0) n0, count(*) FILTER (f1 > 0) n1 FROM c),
k AS (SELECT doc_id, source, -((CASE WHEN ln((n-n0+0.5)/(n0+0.5)) <= 0 THEN 1e-6 ELSE ln((n-n0+0.5)/(n0+0.5)) END) * f0*2.2/(f0+1.2*(0.25+0.75*dl/a)) + (CASE WHEN ln((n-n1+0.5)/(n1+0.5)) <= 0 THEN 1e-6 ELSE ln((n-n1+0.5)/(n1+0.5)) END) * f1*2.2/(f1+1.2*(0.25+0.75*dl/a))) score FROM c, st WHERE f0 > 0 AND f1 > 0)"""


KNN = "v AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) distance FROM embeddings)"


def hybrid(n: int, vector: bool = True, keyword: bool = True, match: str = "true", where: str = "true", tok: str = ASCII) -> str:
    none = "SELECT NULL::BIGINT doc_id, NULL::INT r WHERE false"
    v = f"SELECT vec_id doc_id, row_number() OVER (ORDER BY distance, vec_id)::INT r FROM (SELECT * FROM v ORDER BY distance, vec_id LIMIT {n}) JOIN documents ON doc_id = vec_id WHERE {match}" if vector else none
    if match == "true" and vector:
        v = f"SELECT vec_id doc_id, row_number() OVER (ORDER BY distance, vec_id)::INT r FROM (SELECT * FROM v ORDER BY distance, vec_id LIMIT {n})"
    k = f"SELECT doc_id, row_number() OVER (ORDER BY score, doc_id)::INT r FROM (SELECT * FROM k ORDER BY score, doc_id LIMIT {n}) WHERE {match}" if keyword else none
    return f"""WITH {bm25(tok)}, {KNN}, vr AS ({v}), kr AS ({k}),
f AS (SELECT coalesce(vr.doc_id, kr.doc_id) doc_id, vr.r vector_rank, kr.r keyword_rank, coalesce(1.0::DOUBLE/(60+vr.r),0)+coalesce(1.0::DOUBLE/(60+kr.r),0) score FROM vr FULL JOIN kr ON vr.doc_id = kr.doc_id)
SELECT doc_id, vector_rank, keyword_rank, round(score, 9) score FROM f WHERE {where} ORDER BY f.score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, doc_id LIMIT 10"""


FILES = """files AS (SELECT doc_id, ['md','txt','json','bin'][doc_id%4+1] ext, source||'/'||doc_id||'.'||['md','txt','json','bin'][doc_id%4+1] path, strlen(text) size, doc_id%11<>0 AS exists_, doc_id%13<>0 is_file, doc_id*1000 mtime,
['indexed','failed','pending','missing'][(doc_id%8)//2+1] status, CASE WHEN doc_id%3=0 THEN doc_id*1000 END last_mtime, strlen(text) last_size FROM documents)"""
DECIDED = f"""{FILES}, decided AS (SELECT doc_id, CASE WHEN NOT exists_ THEN 'missing' WHEN NOT is_file THEN 'failed' WHEN ext NOT IN ('md','txt','json') THEN 'unsupported' WHEN ext = 'json' THEN 'excluded' WHEN size > 8000 THEN 'too_large'
WHEN status='indexed' AND mtime IS NOT DISTINCT FROM last_mtime THEN 'skipped' WHEN status='failed' THEN 'skipped' ELSE 'work' END decision FROM files)"""
CONV = """conv AS (SELECT doc_id, ['converted','failed','conflict','pending'][doc_id%4+1] status, (doc_id%5=0 OR doc_id%3=0) src, (doc_id%7<>0 AND doc_id%2<>0) AS out_ FROM documents),
c2 AS (SELECT *, status='conflict' OR (src AND out_) clash FROM conv)"""
MERGED = """old AS (SELECT 'file:/'||source||'/'||doc_id uri, n_chars size, doc_id*10 m, 'h' h, CASE WHEN doc_id%17=0 THEN 'gone' ELSE 'present' END status FROM documents WHERE doc_id%3<>0),
new AS (SELECT 'file:/'||source||'/'||doc_id uri, n_chars size, CASE WHEN doc_id%4=0 THEN doc_id*10+1 ELSE doc_id*10 END m, CASE WHEN doc_id%6<>0 THEN 'h' END h FROM documents WHERE doc_id%5<>0),
j AS (SELECT new.uri nu, old.uri ou, new.size ns, new.h nh, old.h oh, old.status os, (new.size IS DISTINCT FROM old.size OR new.m IS DISTINCT FROM old.m OR (new.h IS NOT NULL AND new.h IS DISTINCT FROM old.h) OR old.status='gone') changed FROM new FULL JOIN old ON new.uri=old.uri)"""


def merged(cap: str, full: bool = True) -> str:
    gone = "nu IS NULL AND os<>'gone'" if full else "false"
    return f"""{MERGED}, m AS (SELECT coalesce(nu, ou) uri, CASE WHEN {gone} THEN 'gone' WHEN nu IS NULL THEN os WHEN {cap} THEN 'too_large' WHEN ou IS NOT NULL AND changed THEN 'modified' ELSE 'present' END status,
CASE WHEN {gone} THEN 'gone' WHEN nu IS NOT NULL AND ou IS NULL THEN 'discovered' WHEN nu IS NOT NULL AND changed THEN 'updated' END outcome, CASE WHEN nu IS NOT NULL THEN coalesce(nh, oh) ELSE oh END content_hash FROM j)"""


REPORT = "SELECT count(*) FILTER (outcome='discovered') discovered, count(*) FILTER (outcome='updated') updated, count(*) FILTER (outcome='gone') gone, count(*) registered FROM m"
SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: trim(s, ' ')), lambda s: len(s) > 0)"

ORACLES = {
    "keyword_bm25_topk": f"WITH {bm25(ASCII)} SELECT doc_id, round(score, 6) score FROM k ORDER BY k.score, doc_id LIMIT 20",
    "keyword_bm25_all_terms": f"WITH {bm25(ASCII)} SELECT doc_id, round(score, 6) score FROM k",
    "vector_knn_l2": f"WITH {KNN} SELECT vec_id, round(distance, 5) distance FROM v ORDER BY v.distance, vec_id LIMIT 20",
    "hybrid_rrf": hybrid(20),
    "hybrid_rrf_filtered": hybrid(20, match="source LIKE 'src1%'"),
    "search_threshold": hybrid(20, where="score >= 0.0150"),
    "vector_only_rrf": hybrid(10, keyword=False),
    "keyword_only_rrf": hybrid(10, vector=False),
    "content_hash": "SELECT doc_id, sha256(text) content_hash FROM documents",
    "token_estimate": "SELECT doc_id, ((strlen(text)+3)//4)::INT tokens FROM documents",
    "sentences": f"SELECT doc_id, len({SENT})::INT n_sentences FROM documents",
    "chunk_greedy_pack": f"""WITH s AS (SELECT doc_id, {SENT} ss FROM documents), r AS (SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'held': ''}}, list_transform(ss, lambda x: {{'done': []::VARCHAR[], 'held': x}})),
lambda a, b: CASE WHEN a.held = '' THEN {{'done': a.done, 'held': b.held}} WHEN (strlen(a.held)+1+strlen(b.held)+3)//4 > 800 THEN {{'done': list_append(a.done, a.held), 'held': b.held}} ELSE {{'done': a.done, 'held': a.held||' '||b.held}} END) st FROM s),
p AS (SELECT doc_id, CASE WHEN st.held = '' THEN st.done ELSE list_append(st.done, st.held) END parts FROM r),
u AS (SELECT doc_id, unnest(parts) part, generate_subscripts(parts, 1) - 1 ordinal FROM p) SELECT doc_id, ordinal::INT ordinal, sha256(part) content_hash FROM u""",
    "chunk_pack_summed": f"""WITH s AS (SELECT doc_id, {SENT} ss FROM documents), r AS (SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'held': ''}}, list_transform(ss, lambda x: {{'done': []::VARCHAR[], 'held': x}})),
lambda a, b: CASE WHEN a.held = '' THEN {{'done': a.done, 'held': b.held}} WHEN (strlen(a.held)+3)//4 + (strlen(b.held)+3)//4 > 800 THEN {{'done': list_append(a.done, a.held), 'held': b.held}} ELSE {{'done': a.done, 'held': a.held||' '||b.held}} END) st FROM s),
p AS (SELECT doc_id, CASE WHEN st.held = '' THEN st.done ELSE list_append(st.done, st.held) END parts FROM r),
u AS (SELECT doc_id, unnest(parts) part, generate_subscripts(parts, 1) - 1 ordinal FROM p) SELECT doc_id, ordinal::INT ordinal, sha256(part) content_hash FROM u""",
    "chunk_ordinals": "WITH p AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents), u AS (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 o FROM p) SELECT doc_id, o::INT ordinal, sha256(line) line_hash FROM u",
    "chunk_overlap": "WITH p AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents), u AS (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 o FROM p), t AS (SELECT doc_id, o, CASE WHEN strlen(line) <= 200 THEN line ELSE right(line, list_min(list_filter(range(50, 201), lambda k: strlen(right(line, k)) >= 200))) END tail FROM u) SELECT doc_id, o::INT ordinal, coalesce(lag(tail) OVER (PARTITION BY doc_id ORDER BY o), '') overlap FROM t",
    "heading_paths": r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 1) l, regexp_extract_all(html, '(?s)<h([1-6])>(.*?)</h[1-6]>', 2) t FROM pages),
u AS (SELECT page_id, unnest(l)::INT level, regexp_replace(unnest(t), '<[^>]*>', '', 'g') title, (generate_subscripts(l, 1) - 1)::INT AS "at" FROM x)
SELECT a.page_id, a."at", (SELECT string_agg(b.title, ' > ' ORDER BY b."at") FROM u b WHERE b.page_id = a.page_id AND b."at" <= a."at" AND b.level <= a.level AND NOT EXISTS (SELECT 1 FROM u c WHERE c.page_id = a.page_id AND c."at" > b."at" AND c."at" <= a."at" AND c.level <= b.level)) heading_path FROM u a""",
    "exact_duplicates": "SELECT sha256(text) content_hash, count(*) n_docs FROM documents GROUP BY 1 HAVING count(*) > 1",
    "status_classify": f"WITH {DECIDED} SELECT * FROM decided",
    "status_counts": f"WITH {FILES} SELECT status, count(*) n_files FROM files GROUP BY 1",
    "status_summary_pivot": f"WITH {DECIDED} SELECT " + ", ".join(f"count(*) FILTER (decision='{d}') {d}" for d in ("missing", "failed", "unsupported", "excluded", "too_large", "skipped", "work")) + ", count(*) registered FROM decided",
    "convert_decision": f"""WITH {CONV} SELECT doc_id,
CASE WHEN status='failed' THEN 'skipped' WHEN clash THEN 'conflict' WHEN NOT src AND out_ THEN 'output_modified' WHEN status='converted' AND NOT src AND NOT out_ THEN 'skipped' ELSE 'convert' END decision,
CASE WHEN clash THEN 'conflict' WHEN NOT src AND out_ THEN 'output_modified' ELSE 'convert' END forced,
CASE WHEN status='failed' THEN 'skipped' WHEN NOT src AND out_ THEN 'output_modified' WHEN status='converted' AND NOT src AND NOT out_ THEN 'skipped' ELSE 'convert' END overwritten,
CASE WHEN status='failed' THEN 'skipped' WHEN clash THEN 'kept_existing_output' WHEN NOT src AND out_ THEN 'output_modified' WHEN status='converted' AND NOT src AND NOT out_ THEN 'skipped' ELSE 'convert' END kept FROM c2""",
    "crawl_upsert": f"WITH {merged('ns > 9000')} SELECT * FROM m",
    "crawl_gone": f"WITH {merged('false')} SELECT uri FROM m WHERE outcome='gone'",
    "crawl_report": f"WITH {merged('ns > 9000')} {REPORT}",
    "crawl_shallow": f"WITH {merged('false', False)} {REPORT}",
    "crawl_incremental_since": "SELECT event_type, count(*) n_events FROM events WHERE epoch_us(ts) >= (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) / 2 FROM events) GROUP BY 1",
    "new_in_last_run": "SELECT user_id FROM events GROUP BY 1 HAVING datediff('day', min(ts)::DATE, max(ts)::DATE) <= 30",
    "orphan_check": "SELECT count(*) orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "consistency_checks": "SELECT count(*) n, 'duplicate_ids' check_name FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT count(*), 'orphan_labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT count(*), 'labels_of_short' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 100)",
    "untracked": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "paths_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "find_substring": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example.com/%' ORDER BY lower(url), page_id",
    "ext_filter": f"WITH {FILES} SELECT doc_id, ext FROM files WHERE ext IN ('md','txt')",
    "glob_filter": f"WITH {FILES} SELECT doc_id, path FROM files WHERE (regexp_full_match(path, 'src1.*/.*[.]md') OR regexp_full_match(path, '(.*/)?.*[.]txt')) AND NOT regexp_full_match(path, 'src./.*5[.].*')",
    "ignore_patterns": f"WITH {FILES} SELECT doc_id, path FROM files WHERE NOT CASE WHEN path LIKE 'src2/%5.txt' THEN false WHEN ext = 'txt' THEN true WHEN path LIKE 'src1/%1.md' THEN true ELSE path LIKE 'src2/%' OR path LIKE 'src4/%' OR regexp_matches(path, '^src3[^/]/') END",
    "new_documents_of_last_run": "WITH d AS (SELECT doc_id, source source_id, (n_chars % 9)::BIGINT first_run_id FROM documents) SELECT * FROM d WHERE first_run_id = (SELECT max(first_run_id) FROM d e WHERE e.source_id = d.source_id)",
    "ignore_filter": f"WITH {FILES} SELECT doc_id, path FROM files WHERE NOT (ext = 'bin' OR path LIKE 'src1/%') OR (path LIKE 'src1/%' AND ext = 'md')",
    "ls_dynamic_filter": f"WITH {FILES} SELECT doc_id, path FROM files WHERE status='indexed' AND ext='md' ORDER BY lower(path), doc_id LIMIT 50",
    "export_paths": f"WITH {FILES} SELECT path FROM files WHERE status IN ('indexed','pending')",
    "export_csv_lines": "WITH t AS (SELECT doc_id, doc_id::VARCHAR a, coalesce(text, '') b, coalesce(lang, '') c, coalesce(source, '') d, coalesce(n_chars::VARCHAR, '') e FROM documents) SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({x}, '[,\"' || chr(10) || ']') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END" for x in "abcde") + ") line FROM t",
    "export_jsonl": "SELECT doc_id, to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR line FROM documents",
    "source_counts": "SELECT source, count(l.doc_id) n_toxic FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY 1",
    "run_totals": "SELECT coalesce(source, 'total') source, count(*) n_docs, sum(n_chars)::BIGINT chars FROM documents GROUP BY ROLLUP(documents.source)",
    "last_seen": "SELECT count(*) n_events, max(ts) last_ts, count(*) FILTER (event_type='error') errors FROM events",
    "needs_ocr": r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}\x{0b}\x{85}]', '', 'g')) < 500 needs_ocr FROM documents",
    "frontmatter": "SELECT doc_id, source title, lang, sha256(text) body_hash FROM documents",
    "span_strip": "SELECT doc_id, source || ' and ' || lang plain FROM documents",
    "annotation_roundtrip": "SELECT doc_id, '<!-- md: source=' || source || '%20dir/' || doc_id || ' hash=' || left(sha256(text), 12) || ' extractor=markdown at=' || doc_id*1000 || ' -->' line, source || '%20dir/' || doc_id parsed FROM documents",
    "output_path": f"WITH {FILES} SELECT doc_id, path || '.md' aware, source || '/' || doc_id || '.md' plain, ext, source || '/' || doc_id stem FROM files JOIN (SELECT doc_id, source FROM documents) USING (doc_id)",
    "sanitize_source": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_. -]', '_', 'g') clean FROM pages",
    "server_rel_url": r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path FROM pages",
    "display_values": "WITH t AS (SELECT *, n_chars*37 b FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fK', floor(b/1024.0::DOUBLE*10+0.5)/10) WHEN b < 1073741824 THEN printf('%.1fM', floor(b/1048576.0::DOUBLE*10+0.5)/10) ELSE printf('%.1fG', floor(b/1073741824.0::DOUBLE*10+0.5)/10) END size, strftime(epoch_ms(doc_id*86400000), '%Y-%m-%d %H:%M') AS at, left(text, 200) preview, CASE WHEN length(source) <= 4 THEN source ELSE left(source, 3) || '…' END short FROM t",
    "whence": f"WITH {FILES} SELECT doc_id, path source, CASE WHEN doc_id%2=0 THEN 'db' ELSE 'annotation' END via FROM files",
    "prune_report": f"WITH {FILES} SELECT status, count(*) removed FROM files WHERE status <> 'indexed' GROUP BY 1",
    "add_report": f"WITH {FILES} SELECT CASE WHEN doc_id%2=0 THEN 'already_registered' ELSE 'added' END outcome, count(*) n FROM files GROUP BY 1",
}

ORACLES |= {
    "keyword_bm25_topk_unicode": f"WITH {bm25(ANY)} SELECT doc_id, round(score, 6) score FROM k ORDER BY k.score, doc_id LIMIT 20",
    "keyword_bm25_all_terms_unicode": f"WITH {bm25(ANY)} SELECT doc_id, round(score, 6) score FROM k",
    "hybrid_rrf_unicode": hybrid(20, tok=ANY),
    "hybrid_rrf_filtered_unicode": hybrid(20, match="source LIKE 'src1%'", tok=ANY),
    "search_threshold_unicode": hybrid(20, where="score >= 0.0150", tok=ANY),
    "keyword_only_rrf_unicode": hybrid(10, vector=False, tok=ANY),
}

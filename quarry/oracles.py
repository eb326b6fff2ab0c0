"""SQL of the main jobs: questions and answers, chunks, text metrics, quality. Stated in other terms than the operators:
pairs instead of indices, recursion instead of folds."""

from __future__ import annotations

from quarry import config

#: Questions with their keywords in order: phrases, then words.
ASKED = r"""
asked AS (
  SELECT item_id AS question_id, text AS question,
    trim(regexp_replace(lower(text), '[.,?!:;()\[\]"''/\\-]', ' ', 'g')) AS norm
  FROM benchmark),
found AS (
  SELECT *, list_filter(['of the', 'in the'], lambda c : contains(norm, c)) AS compounds,
    regexp_extract_all(question, '(?:^|[^A-Za-z0-9_])(\d+[/-][a-zA-Z0-9\x{00C0}-\x{1EF9}]+)', 1) AS numbers,
    regexp_extract_all(question, '(?:^|[^A-Za-z0-9_])(202\d[-/]?202\d|202\d)(?:$|[^A-Za-z0-9_])', 1) AS years
  FROM asked),
worded AS (
  SELECT *, list_filter(string_split_regex(norm, '\s+'), lambda w : length(w) >= 3 AND w NOT IN ('and', 'the', 'that', 'with') AND len(list_filter(compounds, lambda c : contains(c, w))) = 0) AS words
  FROM found),
listed AS (
  SELECT question_id, question, compounds, numbers, list_concat(compounds, list_transform(numbers, lambda n : lower(n)), years, words) AS every FROM worded),
keyed AS (
  SELECT question_id, question, compounds, numbers, list_filter(every, lambda k, i : list_position(every, k) = i) AS keys FROM listed),
asks AS (
  SELECT question_id, question, compounds,
    CASE WHEN len(compounds) > 0 OR len(numbers) > 0 OR len(list_filter(keys, lambda k : contains(k, 'the') OR contains(k, 'tion') OR contains(k, 'ing'))) > 0 THEN keys ELSE [] END AS keys
  FROM keyed)
"""
#: Every question against every page, keyword by keyword.
SCORED = (
    ASKED
    + r""",
low AS (
  SELECT ordinal, lower(title) AS title, lower(coalesce(document_number, '')) AS number, lower(coalesce(category, '')) AS kind, lower(subcategory) AS kind2, lower(content) AS content FROM cat WHERE trim(content) <> ''),
ks AS (SELECT DISTINCT lower(unnest(keys)) AS k FROM asks),
edged AS (
  SELECT k, length(k) > 5 OR contains(k, ' ') OR contains(k, '/') AS loose,
    '(?:^|[\s.,;:!?"''()\[\]/\-])' || regexp_escape(k) || '(?:$|[\s.,;:!?"''()\[\]/\-])' AS form
  FROM ks WHERE k <> ''),
held AS (
  SELECT k, ordinal, contains(title, k) AND (loose OR regexp_matches(title, form)) AS t, contains(number, k) AND (loose OR regexp_matches(number, form)) AS n,
    contains(kind, k) AND (loose OR regexp_matches(kind, form)) OR contains(kind2, k) AND (loose OR regexp_matches(kind2, form)) AS s,
    contains(content, k) AND (loose OR regexp_matches(content, form)) AS x, (length(content) - length(replace(content, k, ''))) // length(k) AS times
  FROM edged, low WHERE contains(title, k) OR contains(number, k) OR contains(kind, k) OR contains(kind2, k) OR contains(content, k)),
pointed AS (
  SELECT k, ordinal, t OR n OR s OR x AS hit,
    CASE WHEN n THEN 35 ELSE 0 END + CASE WHEN t THEN 20 ELSE 0 END + CASE WHEN s THEN 15 ELSE 0 END + CASE WHEN x THEN 5 + least(times - 1, 5) ELSE 0 END AS points
  FROM held),
each AS (SELECT question_id, len(keys) AS size, compounds, unnest(keys) AS word, generate_subscripts(keys, 1) AS pos FROM asks),
met AS (
  SELECT question_id, ordinal, any_value(size) AS size, count(*) FILTER (hit) AS n, sum(points) FILTER (hit) AS points, bool_or(list_contains(compounds, word)) AS phrase,
    any_value(len(compounds)) AS phrases, list(word ORDER BY pos) FILTER (hit) AS matched
  FROM each JOIN pointed ON k = lower(word) GROUP BY 1, 2),
scored AS (
  SELECT question_id, ordinal, matched, floor(points * (0.5 + n / size) * 10 + 0.5) / 10 AS score
  FROM met WHERE n > 0 AND (size = 1 OR n / size >= 0.4) AND (phrases = 0 OR phrase)),
ranked AS (
  SELECT question_id, ordinal, CAST(ordinal AS VARCHAR) AS document_id, matched, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ordinal) AS rank
  FROM scored WHERE score >= {least}),
hits AS (SELECT * FROM ranked WHERE rank <= {k})
"""
)
#: Citations of the hits; every page is its document's only one.
CITED = r""",
said AS (
  SELECT h.*, c.title, c.document_number, c.issue_date, c.category, c.content, trim(regexp_replace(c.content, '\s+', ' ', 'g')) AS flat FROM hits h JOIN cat c USING (ordinal)),
placed AS (
  SELECT *, list_min(list_filter(list_transform(matched, lambda w : strpos(lower(flat), lower(w))), lambda p : p > 0)) - 1 AS first FROM said),
spanned AS (SELECT *, greatest(0, first - 40) AS lo, least(length(flat), greatest(0, first - 40) + 240) AS hi FROM placed)
"""
CLASS = "CASE WHEN trim(question) = '' THEN 'invalid_empty' WHEN length(trim(question)) > 500 THEN 'invalid_long' WHEN len(keys) = 0 THEN 'no_keywords' ELSE 'retrieve' END"

#: Lines as paragraphs; one that is too long comes as sentences. joint: what stands between it and the text before it, or
#: null where a new chunk begins.
CHUNKS = r"""
WITH RECURSIVE whole AS (SELECT doc_id, trim(text) AS t FROM documents),
paras AS (
  SELECT doc_id, i, trim(p) AS p FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS p, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM whole WHERE length(t) > 750)
  WHERE trim(p) <> ''),
cuts AS (
  SELECT doc_id, i, 0 AS j, length(p) AS n, 2 AS joint FROM paras WHERE length(p) <= 750
  UNION ALL
  SELECT doc_id, i, j, length(s), CASE WHEN j > 1 THEN 1 END FROM (
    SELECT doc_id, i, unnest(list) AS s, generate_subscripts(list, 1) AS j
    FROM (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS list FROM paras WHERE length(p) > 750))),
numbered AS (SELECT doc_id, n, joint, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r FROM cuts),
packed AS (
  SELECT doc_id, r, CAST(1 AS BIGINT) AS chunk, CAST(n AS BIGINT) AS tail FROM numbered WHERE r = 1
  UNION ALL
  SELECT p.doc_id, x.r, CASE WHEN p.tail + x.joint + x.n <= 750 THEN p.chunk ELSE p.chunk + 1 END, CASE WHEN p.tail + x.joint + x.n <= 750 THEN p.tail + x.joint + x.n ELSE x.n END
  FROM packed p JOIN numbered x ON x.doc_id = p.doc_id AND x.r = p.r + 1),
chunks AS (
  SELECT doc_id, 1 AS chunk, length(t) AS n FROM whole WHERE length(t) BETWEEN 1 AND 750
  UNION ALL SELECT doc_id, chunk, max(tail) FROM packed GROUP BY 1, 2)
"""


def _metrics(text: str) -> str:
    """Columns of the nine metrics but for lines, over a column of texts; shares to four places, half to even."""
    share = lambda what: f"CASE WHEN ink = 0 THEN 0.0 ELSE round_even({what} / ink, 4) END"
    outside = lambda kind: f"length(regexp_replace({text}, '[^{kind}]+', '', 'g'))"
    odd = config.SUSPICIOUS.replace("'", "''")
    return f"""
  length({text}) AS text_length, ink AS non_whitespace_chars, {share(outside(config.DIACRITICS))} AS diacritics, {share(outside(chr(92) + "p{L}" + chr(92) + "p{N}"))} AS letters,
  {share(outside(odd))} AS suspicious, {share("runs")} AS repeated, len(list_filter(string_split_regex({text}, '\\s+'), lambda w : w <> '')) AS word_count"""


#: Runs of four equal characters or more, a character at a time: the patterns here know no back references.
RUNS = r"""
chars AS (SELECT {key}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {table}),
steps AS (SELECT {key}, c, i, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS new FROM chars WINDOW w AS (PARTITION BY {key} ORDER BY i)),
groups AS (SELECT {key}, c, sum(new) OVER (PARTITION BY {key} ORDER BY i) AS g FROM steps),
long AS (SELECT {key}, g, count(*) AS n FROM groups WHERE c <> chr(10) GROUP BY ALL HAVING count(*) >= {least}),
runs AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS runs, count(*) AS n_runs FROM long GROUP BY ALL)
"""
PAGES = """
cut AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents),
pages AS (
  SELECT id, p AS page_number, array_to_string(lines[(p - 1) * 10 + 1 : p * 10], chr(10)) AS t
  FROM (SELECT id, lines, unnest(range(1, greatest(1, CAST(ceil(len(lines) / 10) AS BIGINT)) + 1)) AS p FROM cut)),
keyed AS (SELECT *, CAST(id AS VARCHAR) || '_' || CAST(page_number AS VARCHAR) AS key FROM pages)
"""
#: Pages with their score and warnings.
PAGE_SCORES = (
    "WITH "
    + PAGES
    + ","
    + RUNS.format(key="key", text="t", table="keyed", least=4)
    + f""",
inked AS (SELECT k.*, length(regexp_replace(t, '\\s+', '', 'g')) AS ink, coalesce(runs, 0) AS runs, list_filter(string_split(t, chr(10)), lambda x : trim(x) <> '') AS full_lines FROM keyed k LEFT JOIN runs USING (key)),
m AS (SELECT id, page_number, t, full_lines, {_metrics("t")}, regexp_matches(t, '(?i)\\bthe\\b') AS legal FROM inked),
w AS (
  SELECT *, list_filter([
    CASE WHEN text_length < 80 THEN 'too_short' END, CASE WHEN suspicious > 0.08 THEN 'many_odd_characters' END, CASE WHEN suspicious > 0.03 AND suspicious <= 0.08 THEN 'odd_characters' END,
    CASE WHEN repeated > 0.1 THEN 'repeated_characters' END, CASE WHEN letters < 0.65 THEN 'few_letters' END,
    CASE WHEN len(full_lines) > 5 AND len(list_filter(full_lines, lambda x : length(x) <= 3)) > 0.4 * len(full_lines) THEN 'broken_lines' END,
    CASE WHEN diacritics < 0.01 AND text_length > 150 THEN 'few_diacritics' END, CASE WHEN NOT legal AND text_length > 300 THEN 'no_legal_pattern' END], lambda x : x IS NOT NULL) AS named
  FROM m),
p AS (
  SELECT *, CASE WHEN non_whitespace_chars = 0 THEN 0 ELSE greatest(0, 100 - list_sum(list_concat([0], list_transform(named, lambda x : map {{'too_short': 40, 'many_odd_characters': 30,
    'odd_characters': 15, 'repeated_characters': 20, 'few_letters': 25, 'broken_lines': 15, 'few_diacritics': 10, 'no_legal_pattern': 10}}[x])))) END AS score
  FROM w)
"""
)
LABEL = "CASE WHEN score >= 90 THEN 'GOOD' WHEN score >= 70 THEN 'ACCEPTABLE' WHEN score >= 50 THEN 'WARNING' ELSE 'POOR' END"
#: Documents' text quality from that of their pages.
TEXT_QUALITY = (
    PAGE_SCORES
    + """,
d AS (
  SELECT id, count(*) AS n_pages, sum(text_length) AS text_length, round_even(count(*) FILTER (non_whitespace_chars = 0) / count(*), 4) AS ratio, round_even(avg(score), 0) AS mean FROM p GROUP BY id),
q AS (
  SELECT id, n_pages, CAST(text_length AS BIGINT) AS text_length, ratio AS empty_page_ratio,
    CAST(least(mean, CASE WHEN ratio > 0.5 THEN 45 ELSE 100 END, CASE WHEN text_length < 100 THEN 40 ELSE 100 END) AS INTEGER) AS score
  FROM d)
"""
)


def _quality(cat: str) -> str:
    """Issues and warnings of catalogue rows by count."""
    odd = config.SUSPICIOUS.replace("'", "''")
    return (
        cat
        + ","
        + RUNS.format(key="ordinal", text="content", table="cat", least=5)
        + rf""",
f AS (
  SELECT c.*, length(regexp_replace(content, '\s+', '', 'g')) AS ink, coalesce(n_runs, 0) AS n_runs, lower(regexp_extract(source_file, '([^/]*)$', 1)) AS file,
    list_transform(regexp_extract_all(title, '[\p{{L}}\p{{N}}\p{{M}}_]{{4,}}'), lambda w : lower(w)) AS words
  FROM cat c LEFT JOIN runs USING (ordinal)),
g AS (
  SELECT id, CASE WHEN trim(title) = '' THEN 1 ELSE 0 END + CASE WHEN trim(content) = '' THEN 1 ELSE 0 END AS n_issues,
    CASE WHEN document_number IS NULL THEN 1 ELSE 0 END + CASE WHEN issue_date IS NULL THEN 1 ELSE 0 END + CASE WHEN trim(content) <> '' AND length(trim(content)) < 100 THEN 1 ELSE 0 END
    + CASE WHEN length(trim(content)) < 30 THEN 1 ELSE 0 END
    + CASE WHEN ink > 0 AND n_runs > 0 THEN 1 ELSE 0 END + CASE WHEN ink > 0 AND length(regexp_replace(content, '[^{odd}]+', '', 'g')) / ink > 0.05 THEN 1 ELSE 0 END
    + CASE WHEN ink > 0 AND 1 - length(regexp_replace(content, '[^\p{{L}}\p{{N}}]+', '', 'g')) / ink > 0.35 THEN 1 ELSE 0 END
    + CASE WHEN content <> '' AND issue_date IS NOT NULL AND NOT contains(content, substr(issue_date, 1, 4)) THEN 1 ELSE 0 END
    + CASE WHEN trim(title) <> '' AND content <> '' AND len(words) > 0 AND len(list_filter(words, lambda w : contains(lower(content), w))) / len(words) < 0.25 THEN 1 ELSE 0 END
    + CASE WHEN ordinal > min(ordinal) OVER (PARTITION BY source_url) THEN 1 ELSE 0 END + CASE WHEN ordinal > min(ordinal) OVER (PARTITION BY file) THEN 1 ELSE 0 END
    + 1 + CASE WHEN effective_status <> 'unknown' THEN 1 ELSE 0 END AS n_warnings
  FROM f),
s AS (SELECT *, greatest(0, 100 - 25 * n_issues - 5 * n_warnings) AS score FROM g),
scored AS (SELECT *, CASE WHEN n_issues > 0 OR score < 50 THEN 'ERROR' WHEN n_warnings > 0 OR score < 85 THEN 'WARNING' ELSE 'GOOD' END AS status FROM s)
"""
    )


#: Notices with the file that is theirs, whose first page names a number and a deadline.
NORMALIZED = """,
n AS (
  SELECT c.ordinal, m.file_ordinal >= 0 AS matched, c.issue_date, CASE WHEN m.file_ordinal >= 0 THEN coalesce(x.document_number, '7/TB') ELSE c.document_number END AS document_number,
    CASE WHEN x.ordinal % 12 = 0 THEN 'http://docs.example/a' || x.id || '.pdf' WHEN c.has_attachment THEN 'http://docs.example/a' || c.id || '.pdf' ELSE 'http://docs.example/d' || c.id || '.html' END AS url,
    CASE WHEN m.file_ordinal >= 0 THEN strftime(CAST(coalesce(x.issue_date, '2024-03-01') AS DATE) + 90, '%Y-%m-%d') END AS deadline
  FROM cat c JOIN matches m USING (ordinal) LEFT JOIN cat x ON x.ordinal = m.file_ordinal),
norm AS (
  SELECT *, 'doc_' || substr(sha256(url), 1, 12) AS id, CASE WHEN matched THEN 0 ELSE 2 END + CASE WHEN document_number IS NULL THEN 1 ELSE 0 END AS n_warnings FROM n)
"""


def decided(deadline: str, as_of: str) -> str:
    """Columns of a status that nothing but a deadline decides."""
    return f"CASE WHEN {deadline} IS NULL THEN 'unverified' WHEN '{as_of}' > {deadline} THEN 'deadline_passed' ELSE 'active' END"


def oracle_sql(cat: str, hits: str, matches: str, as_of: str) -> dict[str, str]:
    """cat: the catalogue in SQL, as a first table; hits: vectors near to each question's, likewise. matches: the files of
    notices, after cat."""
    matched = matches.removeprefix(cat)
    head, _, tail = matched.rpartition(" SELECT n.ordinal")
    normalized = cat + head.replace(", n AS", ", nt AS").replace(" n WHERE", " nt WHERE").replace("FROM n JOIN e ON n.t", "FROM nt n JOIN e ON n.t") + ", matches AS (SELECT n.ordinal" + tail.replace("FROM n ", "FROM nt n ") + ")" + NORMALIZED
    top = lambda least=20, k=4: cat + "," + SCORED.replace("{least}", str(least)).replace("{k}", str(k))
    join_tables = lambda first, second: first + ", " + second.strip().removeprefix("WITH")
    fused = join_tables(top(), hits) + r""",
kw AS (SELECT question_id, document_id, rank AS k_rank, score AS kw, greatest(max(score) OVER (PARTITION BY question_id), 1.0) AS top FROM hits),
sem AS (SELECT question_id, CAST(ordinal AS VARCHAR) AS document_id, rank AS s_rank, floor(sim * 1000 + 0.5) / 1000 AS sem FROM r WHERE rank <= 5),
j AS (
  SELECT coalesce(kw.question_id, sem.question_id) AS question_id, coalesce(kw.document_id, sem.document_id) AS document_id, kw, top, k_rank, sem, s_rank
  FROM kw FULL JOIN sem ON kw.question_id = sem.question_id AND kw.document_id = sem.document_id),
paired AS (SELECT *, bool_or(sem IS NOT NULL) OVER (PARTITION BY question_id) AS hybrid FROM j),
f AS (
  SELECT *, CASE WHEN hybrid THEN coalesce(kw / top * 100, 0) * 0.4 + coalesce(sem, 0) * 100 * 0.6 ELSE kw END AS final FROM paired),
kept AS (SELECT *, CASE WHEN hybrid THEN floor(final * 10 + 0.5) / 10 ELSE final END AS final_score FROM f WHERE final >= 20 OR hybrid AND coalesce(kw, 0) >= 30),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, coalesce(k_rank, 1 << 30), coalesce(s_rank, 1 << 30), document_id) AS rank FROM kept)
SELECT question_id, document_id, CAST(rank AS INTEGER) AS rank, final_score FROM best WHERE rank <= 4"""
    hit = "SELECT question_id, document_id, CAST(rank AS INTEGER) AS rank, score FROM hits"
    context = r""",
b AS (
  SELECT question_id, string_agg('[VĂN BẢN ' || rank || ']' || chr(10) || 'ID: ' || document_id || chr(10) || 'TIÊU ĐỀ: ' || title || chr(10) || 'Số hiệu: ' || coalesce(nullif(document_number, ''), 'Chưa xác định')
    || ' | Ngày ban hành: ' || coalesce(nullif(issue_date, ''), 'Chưa rõ') || ' | Chủ đề: ' || coalesce(nullif(category, ''), 'Chưa phân loại') || chr(10) || 'TRANG: 1' || chr(10) || 'NỘI DUNG:' || chr(10)
    || content || chr(10) || '[/VĂN BẢN ' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS blocks
  FROM said GROUP BY 1)
SELECT item_id AS question_id, CAST(coalesce(length('[VĂN BẢN NGUỒN LIÊN QUAN]' || chr(10) || blocks || chr(10) || '[/VĂN BẢN NGUỒN LIÊN QUAN]'), length('Không có văn bản nào liên quan được tìm thấy trong kho dữ liệu.')) AS INTEGER) AS n
FROM benchmark LEFT JOIN b ON question_id = item_id"""
    sources = """
SELECT question_id, document_id, CAST(rank AS INTEGER) AS rank, 1 AS page, '/documents/' || document_id || '#page-1' AS url,
  CAST(CASE WHEN length(flat) <= 240 THEN length(flat) WHEN first IS NULL THEN 243 ELSE CASE WHEN lo > 0 THEN 3 ELSE 0 END + hi - lo + CASE WHEN hi < length(flat) THEN 3 ELSE 0 END END AS INTEGER) AS n_snippet
FROM spanned"""
    # of an address of the tables: scheme and host, path, query; fragments go
    url = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1)"
    quality = _quality(cat)
    tags = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', chr(10), 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
        tags = f"replace({tags}, '{entity}', {char})"
    trimmed = f"array_to_string(list_transform(string_split(replace({tags}, chr(13) || chr(10), chr(10)), chr(10)), lambda x : rtrim(x)), chr(10))"
    plain = f"trim(regexp_replace({trimmed}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    login = "regexp_matches(lower(url), 'dang-nhap|logout') OR regexp_matches(html, '(?i)<input[^>]*name=[\"''][^\"'']*username') AND regexp_matches(html, '(?i)<input[^>]*name=[\"''][^\"'']*password') OR contains(html, 'Vui lòng đăng nhập lại hệ thống')"
    captcha = "regexp_matches(html, '(?i)class=[\"''][^\"'']*(captcha|cf-turnstile)') OR regexp_matches(html, '(?i)<iframe[^>]*(captcha|turnstile)') OR regexp_matches(html, '(?i)<input[^>]*name=[\"''][^\"'']*captcha') OR regexp_matches(lower(html), 'xác nhận không phải người máy|nhập mã bảo vệ|mã captcha')"
    metrics = (
        "WITH " + RUNS.format(key="doc_id", text="text", table="documents", least=4).strip()
        + rf""",
i AS (SELECT d.doc_id, d.text AS t, coalesce(runs, 0) AS runs, length(regexp_replace(d.text, '\s+', '', 'g')) AS ink FROM documents d LEFT JOIN runs USING (doc_id)),
m AS (SELECT doc_id, t, {_metrics("t")} FROM i)
SELECT doc_id, CAST(text_length AS INTEGER) AS text_length, CAST(non_whitespace_chars AS INTEGER) AS non_whitespace_chars, letters AS alphanumeric_ratio, suspicious AS suspicious_character_ratio,
  repeated AS repeated_character_ratio, CAST(word_count AS INTEGER) AS word_count, concat_ws(',', CASE WHEN regexp_matches(t, '(?i)\bthe\b') THEN 'the' END, CASE WHEN regexp_matches(t, '\b\d+\b') THEN 'number' END) AS patterns
FROM m"""
    )
    return {
        "route_questions": "WITH " + ASKED + f"SELECT question_id, {CLASS} AS question_class, array_to_string(keys, ',') AS keywords FROM asks",
        "top_keyword": top() + hit,
        "top_keyword_indexed": top() + hit,
        "fuse_hybrid": fused,
        "build_sources": top() + CITED + sources,
        "assemble_context": top() + CITED + context,
        "answer_questions": top() + f", n AS (SELECT question_id, count(*) AS n FROM hits GROUP BY 1) SELECT question_id, {CLASS} AS question_class, coalesce(n, 0) AS n_sources FROM asks LEFT JOIN n USING (question_id)",
        "chunk_pages": CHUNKS + "SELECT doc_id || '_p1_c' || chunk AS chunk_id, CAST(n AS INTEGER) AS n FROM chunks",
        "embed_chunks": CHUNKS + "SELECT count(*) AS n_chunks, 0 AS failed FROM chunks",
        "dashboard_totals": CHUNKS + "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents) AS n_pages, count(*) AS n_chunks FROM chunks",
        "text_metrics": metrics,
        "page_scores": PAGE_SCORES + f"SELECT id, CAST(page_number AS INTEGER) AS page_number, CAST(score AS INTEGER) AS score, {LABEL} AS label, CASE WHEN non_whitespace_chars = 0 THEN 'empty' ELSE array_to_string(named, ',') END AS warnings FROM p",
        "document_text_quality": TEXT_QUALITY + f"SELECT *, {LABEL} AS label FROM q",
        "text_quality_report": TEXT_QUALITY + f", l AS (SELECT *, {LABEL} AS label FROM q) SELECT count(*) AS n_documents, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(text_length) AS BIGINT) AS n_chars, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x.lower()}" for x in ("GOOD", "ACCEPTABLE", "WARNING", "POOR")) + " FROM l",
        "quality_checks": quality + "SELECT id, CAST(n_issues AS INTEGER) AS n_issues, CAST(n_warnings AS INTEGER) AS n_warnings, CAST(score AS INTEGER) AS score, status FROM scored",
        "quality_report": quality + "SELECT count(*) AS n_documents, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x.lower()}" for x in ("GOOD", "WARNING", "ERROR")) + ", CAST(sum(n_issues) AS BIGINT) AS n_issues, CAST(sum(n_warnings) AS BIGINT) AS n_warnings, round_even(sum(score) * 100.0 / count(*), 0) / 100 AS mean_score FROM scored",
        "normalize_documents": normalized + f"SELECT ordinal, id, document_number, issue_date, deadline, {decided('deadline', as_of)} AS suggested_status, CASE WHEN deadline IS NULL THEN 'LOW' ELSE 'HIGH' END AS certainty, CAST(n_warnings AS INTEGER) AS n_warnings FROM norm",
        "normalization_report": normalized + "SELECT count(*) AS n_documents, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS missing, CAST(sum(n_warnings) AS BIGINT) AS n_warnings, count(*) FILTER (document_number IS NULL) AS no_number, count(*) FILTER (issue_date IS NULL) AS no_date FROM norm",
        "reapply_validity": cat + f"SELECT id, CASE WHEN is_verified THEN effective_status ELSE {decided('issue_date', as_of)} END AS effective_status, CASE WHEN NOT is_verified THEN CASE WHEN issue_date IS NULL THEN 'LOW' ELSE 'HIGH' END END AS certainty FROM cat",
        "html_text": f"SELECT page_id, CAST(length({plain}) AS INTEGER) AS n FROM pages",
        "access_state": f"SELECT page_id, CASE WHEN {login} THEN 'login' WHEN {captcha} THEN 'captcha' WHEN page_id % 9 = 0 THEN 'blocked' ELSE 'ok' END AS state FROM pages",
        "normalize_url": f"SELECT page_id, {url} AS url FROM pages",
        "match_details": cat + ", t AS (SELECT *, regexp_replace(title, '\\s+', ' ', 'g') AS n FROM cat), f AS (SELECT n, min(ordinal) AS first FROM t GROUP BY 1) SELECT ordinal AS detail_ordinal, CASE WHEN length(n) >= 15 THEN least(first, CASE WHEN ordinal % 2 = 0 THEN ordinal ELSE first END) WHEN ordinal % 2 = 0 THEN ordinal END AS notice_ordinal FROM t JOIN f USING (n)",
    }

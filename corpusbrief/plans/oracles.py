"""Check SQL for the registered queries, written from the semantics for an independent engine.

Paths are compared as lists, bundles are built by aggregating whole segments and cutting the
result, URLs are taken apart with list functions, and the event fold uses correlated "last row"
windows: other formulations than the DataFrame ones on purpose.
"""

from __future__ import annotations

from ..functions import rules
from .catalog import CHAT_MODEL, CREATED, ONE_USER, REPO_PARAMS
from .fixtures import check_view


def _text(value: str) -> str:
    """A string literal; control characters are spelled chr()."""
    pieces, plain = [], ""
    for char in value:
        if char < " ":
            pieces += [f"'{plain}'"] if plain else []
            pieces.append(f"chr({ord(char)})")
            plain = ""
        else:
            plain += "''" if char == "'" else char
    pieces += [f"'{plain}'"] if plain or not pieces else []
    return "(" + " || ".join(pieces) + ")"


def _set(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _mapping(rows: dict[str, str]) -> str:
    return ", ".join(f"({_text(k)}, {_text(v)})" for k, v in rows.items())


def _strip(column: str) -> str:
    spaces = " || ".join(f"chr({ord(c)})" for c in rules.WHITESPACE)
    return f"trim({column}, {spaces})"


_CODE = _set(rules.CODE_EXTENSIONS)
_TEXT = _set(rules.TEXT_EXTENSIONS)
_IMPORTANT = _mapping({n: c for c, names in rules.IMPORTANT_NAMES.items() for n in names})

_FILES = f"files AS ({check_view('files')})"
_HISTORY = f"history AS ({check_view('history')})"
_EVENTS = f"status_events AS ({check_view('status_events')})"
_REQUESTS = f"requests AS ({check_view('requests')})"
_OUTPUTS = f"model_outputs AS ({check_view('model_outputs')})"

_PARTS = f"""{_FILES},
important_names(file_name, category) AS (VALUES {_IMPORTANT}),
split AS (
  SELECT *, string_split(path, '/') AS comps FROM files),
named AS (
  SELECT *, comps[len(comps)] AS name, comps[1:len(comps)-1] AS dirs,
    CASE WHEN regexp_matches(comps[len(comps)], '^.+[.][^.]+$')
         THEN lower('.' || list_last(string_split(comps[len(comps)], '.'))) ELSE '' END AS ext
  FROM split),
parts AS (
  SELECT named.*, important_names.category,
    CASE WHEN important_names.category IS NOT NULL THEN 'important'
         WHEN ext IN {_CODE} THEN 'source' ELSE 'other' END AS file_class,
    list_concat(list_transform(dirs, lambda d: '1' || d), ['0' || name]) AS walk,
    len(list_filter(dirs, lambda d: lower(d) IN {_set(rules.IGNORED_DIRECTORIES)} OR d[1] = '.')) > 0 AS bad_dir,
    name[1] = '.' AS bad_name,
    ext IN {_set(rules.IGNORED_EXTENSIONS)} AS bad_ext
  FROM named LEFT JOIN important_names ON file_name = lower(name))"""

_SELECTED = f"""{_PARTS},
selected AS (
  SELECT * FROM parts WHERE NOT bad_dir AND NOT bad_name AND NOT bad_ext
    AND size >= {rules.MIN_FILE_BYTES} AND size <= {rules.MAX_FILE_BYTES} AND content <> '')"""

_CAPPED = f"""{_SELECTED},
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY repo_id, file_class ORDER BY walk ROWS UNBOUNDED PRECEDING) AS place
  FROM selected WHERE file_class <> 'other'),
capped AS (SELECT * FROM ranked WHERE file_class = 'important' OR place <= {rules.SOURCE_CAP}),
segments AS (
  SELECT *, {_text(rules.SEGMENT_HEAD)} || path || {_text(rules.SEGMENT_MID)} || content || {_text(rules.SEGMENT_TAIL)} AS segment
  FROM capped)"""

_BUNDLED = f"""{_CAPPED},
joined AS (
  SELECT repo_id, string_agg(segment, '' ORDER BY file_class, walk) AS whole,
    CAST(sum(CASE WHEN file_class = 'important' THEN length(segment) ELSE 0 END) AS BIGINT) AS important_chars
  FROM segments GROUP BY repo_id),
bundles AS (
  SELECT repo_id, important_chars, length(whole) AS total_chars, length(whole) > {rules.TEXT_BUDGET} AS truncated,
    CASE WHEN length(whole) > {rules.TEXT_BUDGET}
         THEN whole[1:{rules.TEXT_BUDGET}] || {_text(rules.TRUNCATION_MARK)} ELSE whole END AS text
  FROM joined)"""

_GUIDES = f"""lengths(size_name, length_text) AS (VALUES {_mapping(rules.LENGTH_GUIDANCE)}),
aliases(alias, meaning) AS (VALUES {_mapping(rules.TECHNICALITY_ALIASES)}),
audiences(audience, audience_text) AS (VALUES {_mapping(rules.AUDIENCE_GUIDANCE)})"""


def _guided(source: str) -> str:
    """Rows of a relation with lang, size, technicality, joined to their guidance texts."""
    return f"""
  SELECT g.*, coalesce(length_text, {_text(rules.LENGTH_GUIDANCE_OTHER)}) AS length_guidance,
    coalesce(audience_text, {_text(rules.AUDIENCE_GUIDANCE_OTHER)}) AS audience_guidance
  FROM (
    SELECT s.*, coalesce(meaning, wanted) AS norm
    FROM (SELECT *, lower({_strip("CASE WHEN coalesce(technicality, '') = '' THEN 'technical' ELSE technicality END")}) AS wanted
          FROM {source}) AS s
    LEFT JOIN aliases ON alias = wanted) AS g
  LEFT JOIN lengths ON size_name = lower(CASE WHEN coalesce(size, '') = '' THEN 'medium' ELSE size END)
  LEFT JOIN audiences ON audience = norm"""


def _prompt(lang: str, length: str, audience: str, text: str) -> str:
    sql = rules.PROMPT_TEMPLATE
    pieces = []
    for name, column in (("lang", lang), ("length", length), ("audience", audience), ("text", text)):
        before, sql = sql.split("{" + name + "}")
        pieces += [_text(before), column]
    return " || ".join([*pieces, _text(sql)])


_PARAM_ROWS = ", ".join(f"('{repo}', {', '.join(_text(p) for p in params)})" for repo, params in REPO_PARAMS.items())

_PROMPTED = f"""{_BUNDLED}, {_GUIDES},
repo_params(pid, p_lang, p_size, p_tech) AS (VALUES {_PARAM_ROWS}),
wished AS (
  SELECT bundles.*, coalesce(p_lang, 'en') AS lang, coalesce(p_size, 'medium') AS size,
    coalesce(p_tech, 'technical') AS technicality
  FROM bundles LEFT JOIN repo_params ON pid = repo_id),
guided AS ({_guided('wished')}),
prompted AS (
  SELECT *, {_prompt('lang', 'length_guidance', 'audience_guidance', 'text')} AS prompt FROM guided)"""

_HTTP_OK = f"""(regexp_matches(lower(url), '^https?://[^/?#]') AND length(url) <= 2083)"""

_CHECKED = f"""{_REQUESTS},
pieces AS (
  SELECT *, {_HTTP_OK} AS fine, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS authority FROM requests),
checked AS (
  SELECT request_id, coalesce(lang, 'en') AS lang, coalesce(size, 'medium') AS size,
    coalesce(technicality, 'technical') AS technicality,
    CASE WHEN NOT fine THEN 'url must be an http or https URL with a host' END AS reject_reason,
    CASE WHEN NOT fine THEN url ELSE
      lower(string_split(url, '://')[1]) || '://' ||
      CASE WHEN contains(authority, '@') THEN string_split(authority, '@')[1] || '@' || lower(string_split(authority, '@')[2])
           ELSE lower(authority) END ||
      CASE WHEN url[length(string_split(url, '://')[1]) + 3 + length(authority) + 1:] LIKE '/%' THEN '' ELSE '/' END ||
      url[length(string_split(url, '://')[1]) + 3 + length(authority) + 1:] END AS url
  FROM pieces)"""

_NAMED_REPOS = """cut AS (
  SELECT *, starts_with(url, 'git@') AS ssh,
    CASE WHEN starts_with(url, 'git@') THEN string_split(url[strpos(url, ':') + 1:], '/')
         ELSE string_split(trim(string_split(string_split(
           array_to_string((string_split(string_split(url, '://')[2], '/'))[2:], '/'), '?')[1], '#')[1], '/'), '/') END AS p,
    string_split(string_split(url, '://')[2], '/')[1] AS host
  FROM requests),
judged AS (
  SELECT *, CASE WHEN len(p) > 1 THEN replace(p[2], '.git', '') END AS r,
    CASE WHEN coalesce(url, '') = '' THEN 'URL must be a non-empty string'
         WHEN ssh AND len(p) < 2 THEN 'Invalid SSH URL format: ' || url
         WHEN NOT ssh AND NOT contains(lower(coalesce(host, '')), 'github.com') THEN 'URL does not appear to be a GitHub URL: ' || url
         WHEN len(p) < 2 THEN 'GitHub URL path must include owner/repo: ' || url
         WHEN p[1] = '' OR replace(p[2], '.git', '') = '' THEN
           CASE WHEN ssh THEN 'Invalid owner or repo name in SSH URL: ' ELSE 'Invalid owner or repo name in URL path: ' END || url
    END AS error FROM cut)"""

_CREATED_JOBS = f"""{_CHECKED}, {_HISTORY},
jobs AS (
  SELECT (SELECT max(id) FROM history) + row_number() OVER (ORDER BY request_id) AS id, request_id,
    url AS repository_url, lang, size, technicality
  FROM checked WHERE reject_reason IS NULL)"""

_VALID = f"""{_EVENTS},
judged AS (
  SELECT *, CASE
    WHEN analysis_id IS NULL OR analysis_id = 0 OR status IS NULL OR status = '' THEN 'missing id or status'
    WHEN status NOT IN {_set(rules.STATUSES)} THEN 'unknown status' END AS reject_reason
  FROM status_events)"""

# the newest event of a job, and apart from it the newest COMPLETED one
_FOLDED = f"""{_VALID},
newest AS (
  SELECT * FROM judged WHERE reject_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY seq DESC) = 1),
newest_done AS (
  SELECT analysis_id, summary FROM judged WHERE reject_reason IS NULL AND status = 'COMPLETED'
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY seq DESC) = 1),
folds AS (
  SELECT newest.analysis_id, newest.status, newest_done.analysis_id IS NOT NULL AS summary_set, newest_done.summary,
    CASE WHEN newest.status = 'FAILED' THEN newest.error END AS error, newest.ts AS updated_at
  FROM newest LEFT JOIN newest_done ON newest_done.analysis_id = newest.analysis_id)"""


def _error_of(kind: str, detail: str) -> str:
    cut = f"coalesce({detail}, '')[1:{rules.ERROR_DETAIL_CHARS}]"
    return f"""CASE {kind} WHEN 'clone' THEN {_text(rules.CLONE_FAILED)} || {cut}
    WHEN 'internal' THEN {_text(rules.REPOSITORY_INTERNAL)} || {cut}
    WHEN 'api' THEN {_text(rules.API_ERROR)} || coalesce({detail}, '')
    WHEN 'unexpected' THEN {_text(rules.UNEXPECTED_AI)} || coalesce({detail}, '')
    WHEN 'blank_repository' THEN {_text(rules.BLANK_REPOSITORY)} END"""


_KIND = "(['clone', 'internal', 'api', 'unexpected', 'blank_repository'])[id % 5 + 1]"

# chat responses of the test conversations: raw text, what the body says, by kind
_SAID = f"""{_OUTPUTS},
said AS (SELECT *, (conv_id + turn) % 6 AS kind, {_strip('text')} AS words FROM model_outputs)"""

_FLAGS = """WITH {history}, minutes AS (
  SELECT date_trunc('minute', created_at) AS minute, coalesce(user_id, 'guest') AS rate_key, user_id IS NULL AS is_guest, count(*) AS n
  FROM history GROUP BY ALL)
SELECT minute, rate_key, is_guest, n FROM minutes WHERE n > 1""".format(history=_HISTORY)

# requests of the whole-job queries: the repository each asks for, prompt size included
_BRIEFED = f"""{_BUNDLED}, {_GUIDES}, {_CHECKED},
repos AS (SELECT {list((*REPO_PARAMS, "es", "none"))} AS names),
guided AS ({_guided('checked')}),
numbered AS (
  SELECT row_number() OVER (ORDER BY request_id) AS place, guided.*, (SELECT names FROM repos)[request_id % 5 + 1] AS repo
  FROM guided WHERE reject_reason IS NULL),
briefed AS (
  SELECT numbered.*, bundles.text,
    {_prompt('numbered.lang', 'length_guidance', 'audience_guidance', 'bundles.text')} AS prompt
  FROM numbered LEFT JOIN bundles ON bundles.repo_id = repo)"""

# what the offline provider makes of a prompt: the first sentence after each file header
_HEADED = "list_filter(string_split(prompt, '--- File: ')[2:], lambda p: regexp_matches(p, '^[^' || chr(10) || ']* ---(' || chr(10) || '|$)'))"
_ITEM = f"""'<li>' || regexp_extract(p, '^([^' || chr(10) || ']*) ---', 1) || ': ' || {_strip(
    "regexp_extract(p[length(regexp_extract(p, '^([^' || chr(10) || ']*) ---', 1)) + 5:], '[^.!?' || chr(10) || ']+[.!?]?')")} || '</li>'"""
_EXTRACT = f"""('<p>' || len({_HEADED}) || ' files, ' || length(prompt) || ' characters</p><ul>' ||
  array_to_string(list_transform({_HEADED}, lambda p: {_ITEM}), '') || '</ul>')"""

_LOOKUP_SQL = f"""WITH {_HISTORY}, asked AS (
  SELECT id AS request_id, CASE WHEN id % 11 = 0 THEN -id ELSE id END AS id,
    CASE id % 4 WHEN 0 THEN user_id WHEN 1 THEN 'nobody' WHEN 3 THEN '' END AS asker FROM history),
seen AS (
  SELECT asked.request_id, asked.id, asker, h.repository_url, h.status, h.id IS NOT NULL AS found
  FROM asked LEFT JOIN history h ON h.id = asked.id AND (asker IS NULL OR asker = '' OR asker = h.user_id))
SELECT request_id, id, found, repository_url, status,
  CASE WHEN NOT found THEN CASE WHEN asker IS NULL OR asker = '' THEN 'Analysis not found.'
    ELSE 'Analysis not found or access denied.' END END AS not_found_message
FROM seen"""

_ADMISSION_SQL = f"""WITH {_HISTORY}, asked AS (
  SELECT id, user_id, created_at, coalesce(user_id, '') AS owner, (
    SELECT count(*) FROM history e WHERE coalesce(e.user_id, '') = coalesce(h.user_id, '')
      AND date_trunc('minute', e.created_at) = date_trunc('minute', h.created_at)
      AND (e.created_at < h.created_at OR (e.created_at = h.created_at AND e.id < h.id))) AS earlier
  FROM history h)
SELECT id, user_id, created_at, earlier < CASE WHEN owner = '' THEN 1 ELSE 2 END AS admitted FROM asked"""

_FOLD_SQL = f"WITH {_FOLDED} SELECT * FROM folds"


def oracle_sql() -> dict[str, str]:
    kept = f"{_PARTS} SELECT repo_id, path FROM parts WHERE NOT"
    return {
        "q_files": f"WITH {_FILES} SELECT repo_id, path, size, md5(content) AS content_md5 FROM files",
        "q_dir_prune": f"WITH {kept} bad_dir",
        "q_name_prune": f"WITH {kept} bad_name",
        "q_ext_prune": f"WITH {kept} bad_ext",
        "q_size_gate": f"WITH {_FILES} SELECT repo_id, path, size FROM files WHERE size >= 10 AND size <= 1048576",
        "q_binary_sniff": """
            SELECT doc_id, 'bin/t' || doc_id || CASE WHEN doc_id % 8 >= 4 THEN '.py' ELSE '' END AS path,
              doc_id % 4 = 1 AND doc_id % 8 < 4 AS is_binary FROM documents""",
        "q_decode_text": f"""
            WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65533) || text ELSE text END AS text FROM documents)
            SELECT doc_id, length(text) AS n, md5(text) AS text_md5 FROM d""",
        "q_select": f"WITH {_SELECTED} SELECT repo_id, path, category, file_class FROM selected",
        "q_selection_audit": f"""WITH {_PARTS}, marked AS (
              SELECT repo_id, CASE WHEN bad_dir THEN 'directory' WHEN bad_name THEN 'name' WHEN bad_ext THEN 'extension'
                WHEN ext NOT IN {_TEXT} AND ext NOT IN {_CODE} AND contains(content[1:{rules.SNIFF_BYTES}], chr(0)) THEN 'binary'
                WHEN size > {rules.MAX_FILE_BYTES} THEN 'too_large' WHEN size < {rules.MIN_FILE_BYTES} THEN 'too_small'
                WHEN content = '' THEN 'empty' ELSE 'kept' END AS reason FROM parts)
            SELECT repo_id, reason, count(*) AS n FROM marked GROUP BY repo_id, reason""",
        "q_path_parts": f"WITH {_PARTS} SELECT path, name, ext, array_to_string(dirs, '/') AS parent FROM parts",
        "q_important": f"WITH {_PARTS} SELECT path, category FROM parts",
        "q_class": f"WITH {_PARTS} SELECT path, file_class FROM parts",
        "q_category_counts": f"""WITH {_SELECTED}
            SELECT repo_id, category, count(*) AS n FROM selected WHERE category IS NOT NULL GROUP BY repo_id, category""",
        "q_walk_order": f"""WITH {_PARTS}
            SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY walk) AS position FROM parts""",
        "q_cap_sources": f"WITH {_CAPPED} SELECT repo_id, path, file_class FROM capped",
        "q_parse_counts": f"""WITH {_CAPPED}
            SELECT repo_id, count(*) FILTER (file_class = 'important') AS important,
              count(*) FILTER (file_class = 'source') AS source, count(*) AS processed FROM capped GROUP BY repo_id""",
        "q_segments": f"WITH {_CAPPED} SELECT repo_id, path, md5(segment) AS segment_md5, length(segment) AS n FROM segments",
        "q_assemble": f"WITH {_BUNDLED} SELECT repo_id, text, total_chars, truncated FROM bundles",
        "q_assemble_salted": f"WITH {_BUNDLED} SELECT repo_id, text, total_chars, truncated FROM bundles",
        "q_bundle_metrics": f"""WITH {_PROMPTED}
            SELECT repo_id, total_chars, important_chars, total_chars - important_chars AS source_chars,
              important_chars / total_chars AS important_share, length(text) AS bundle_chars,
              length({_strip('text')}) AS stripped_chars, length(prompt) AS prompt_chars, truncated
            FROM prompted""",
        "q_blank_route": f"""WITH {_BUNDLED}, repos AS (
              SELECT DISTINCT lang AS repo_id FROM documents UNION SELECT DISTINCT 'none-' || lang FROM documents)
            SELECT repos.repo_id, CASE WHEN {_strip("coalesce(text, '')")} = '' THEN 'failed' ELSE 'analyse' END AS route,
              CASE WHEN {_strip("coalesce(text, '')")} = '' THEN {_text(rules.BLANK_REPOSITORY)} END AS error
            FROM repos LEFT JOIN bundles ON bundles.repo_id = repos.repo_id""",
        "q_requests": f"WITH {_CHECKED} SELECT request_id, url, lang, size, technicality, reject_reason FROM checked",
        "q_repo_url": f"""WITH {_REQUESTS}, {_NAMED_REPOS}
            SELECT request_id, CASE WHEN error IS NULL THEN p[1] END AS owner, CASE WHEN error IS NULL THEN r END AS repo,
              CASE WHEN error IS NULL THEN 'https://github.com/' || p[1] || '/' || r || '.git' END AS canonical_url, error
            FROM judged""",
        "q_redact": f"""WITH {_REQUESTS}
            SELECT request_id, CASE WHEN page_tok THEN 'https://[REDACTED_TOKEN]@' || string_split(url, '@')[2] ELSE url END AS url
            FROM (SELECT *, regexp_matches(url, '://[^/@]+@') AS page_tok FROM requests)""",
        "q_guidance": f"""WITH {_REQUESTS}, {_GUIDES}, guided AS ({_guided('requests')})
            SELECT request_id, length_guidance, norm AS technicality, audience_guidance FROM guided""",
        "q_create_jobs": f"""WITH {_CREATED_JOBS}
            SELECT id, request_id, repository_url, TIMESTAMP '{CREATED}' AS created_at, lang, size, technicality, 'QUEUED' AS status FROM jobs""",
        "q_compensate": f"""WITH {_CREATED_JOBS}, {_NAMED_REPOS}
            SELECT id, request_id, repository_url FROM jobs
            WHERE request_id NOT IN (SELECT request_id FROM judged WHERE error IS NOT NULL)""",
        "q_clone_error": f"""WITH d AS (
              SELECT doc_id, doc_id % 2 = 0 AS tok, CASE doc_id % 5
                WHEN 0 THEN 'fatal: Authentication failed for ''x''' || chr(10) || coalesce(text, '')
                WHEN 1 THEN 'fatal: could not read Username for ''x''' || chr(10) || coalesce(text, '')
                WHEN 2 THEN coalesce(text, '') || chr(10) || 'remote: Repository not found.' || chr(10)
                WHEN 3 THEN '  ' || coalesce(text, '') || chr(10)
                ELSE repeat(chr(10), CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT)) END AS stderr
              FROM documents), s AS (SELECT *, {_strip('stderr')} AS said FROM d)
            SELECT doc_id, 'Failed to clone repository ''https://[REDACTED_TOKEN]@github.com/o/r.git''. Git command failed (exit 128).' ||
              CASE WHEN stderr = '' THEN ' Git error: No stderr output.'
                   WHEN tok AND position('Authentication failed' IN said) > 0 THEN ' Authentication failed.'
                   WHEN NOT tok AND (position('Authentication failed' IN said) > 0 OR position('could not read Username' IN said) > 0)
                     THEN ' Authentication failed. This may be a private repository.'
                   WHEN position('Repository not found' IN said) > 0 THEN ' Repository not found or access denied.'
                   WHEN said = '' THEN ''
                   ELSE ' Git error: ' || said[1:{rules.CLONE_DETAIL_CHARS}] END AS error,
              {_text(rules.CLONE_FAILED)} || stderr[1:{rules.ERROR_DETAIL_CHARS}] AS stored_error
            FROM s""",
        "q_rate_flags": _FLAGS,
        "q_admission": _ADMISSION_SQL,
        "q_stream_admission": _ADMISSION_SQL,
        "q_prompt": f"""WITH {_PROMPTED}
            SELECT repo_id, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5, sha256(prompt)[1:16] AS prompt_hash FROM prompted""",
        "q_chat_request": f"""WITH {_PROMPTED}, body AS (
              SELECT repo_id, '{{"model":"{CHAT_MODEL}","messages":[{{"role":"user","content":' || CAST(to_json(prompt) AS VARCHAR)
                || '}}],"temperature":0.6' AS open FROM prompted)
            SELECT repo_id, md5(open || '}}') AS open_md5, md5(open || ',"max_tokens":2048}}') AS limited_md5 FROM body""",
        "q_chat_parse": f"""WITH {_SAID}
            SELECT conv_id, turn,
              CASE WHEN kind IN (0, 2) AND words <> '' THEN words
                   WHEN kind = 1 THEN {_strip("' ' || text || chr(10) || '7end'")} END AS output,
              CASE kind WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END AS finish_reason,
              CASE WHEN kind = 5 THEN 'Response is not a JSON object.' WHEN kind = 3 THEN {_text(rules.NO_CHOICES)}
                   WHEN kind = 4 OR (kind IN (0, 2) AND words = '') THEN {_text(rules.NO_USABLE_CONTENT)} END AS error
            FROM said""",
        "q_probe_health": f"""WITH {_SAID}, seen AS (
              SELECT *, kind = 1 OR (kind IN (0, 2) AND words <> '') AS healthy FROM said)
            SELECT conv_id, turn, healthy,
              CASE WHEN healthy THEN CASE WHEN kind = 2 THEN 'reasoning' ELSE 'content' END END AS output_mode,
              CASE WHEN kind = 5 THEN {_text(rules.PROBE_FAILED)} || 'ValueError: response is not a JSON object'
                   WHEN healthy THEN {_text(rules.PROBE_OK)} ELSE {_text(rules.PROBE_EMPTY)} END AS message
            FROM seen""",
        "q_candidates": f"""WITH {_OUTPUTS}, k AS (SELECT *, (conv_id + turn) % 4 AS kind FROM model_outputs)
            SELECT conv_id, turn, CASE WHEN kind = 3 THEN {_strip('output')} END AS output,
              CASE kind WHEN 1 THEN 'MAX_TOKENS' WHEN 2 THEN 'UNKNOWN' ELSE 'STOP' END AS finish_reason,
              CASE kind WHEN 0 THEN {_text(rules.BLOCKED)} || 'SAFETY' WHEN 1 THEN {_text(rules.NO_CANDIDATE)} || 'MAX_TOKENS'
                WHEN 2 THEN {_text(rules.NO_CANDIDATE)} || 'UNKNOWN' END AS error
            FROM k""",
        "q_clean_output": f"""WITH {_OUTPUTS}, a AS (SELECT *, {_strip('output')} AS s FROM model_outputs),
            b AS (SELECT *, CASE WHEN s LIKE '```html%' THEN s[8:] WHEN s LIKE '```%' THEN s[4:] ELSE s END AS t FROM a),
            c AS (SELECT *, CASE WHEN suffix(t, '```') THEN t[1:length(t) - 3] ELSE t END AS u FROM b)
            SELECT conv_id, turn, {_strip('u')} AS cleaned FROM c""",
        "q_ai_payload": f"""WITH {_OUTPUTS}, k AS (SELECT *, (conv_id + turn) % 6 AS kind FROM model_outputs)
            SELECT conv_id, turn,
              CASE WHEN kind = 3 THEN 0 WHEN kind <> 5 THEN conv_id + 1 END AS analysis_id,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN '42.0' WHEN 5 THEN NULL ELSE text END AS text,
              CASE kind WHEN 0 THEN 'es' WHEN 2 THEN NULL ELSE 'en' END AS lang,
              CASE kind WHEN 0 THEN 'small' ELSE 'medium' END AS size,
              CASE kind WHEN 0 THEN 'expert' ELSE 'technical' END AS technicality,
              CASE kind WHEN 5 THEN 'payload is not a map' WHEN 3 THEN 'missing analysis_id'
                WHEN 4 THEN 'missing result_queue_name' END AS reject_reason
            FROM k""",
        "q_generate": f"""WITH d AS (
              SELECT *, {_text(rules.SEGMENT_HEAD)} || 'doc.md' || {_text(rules.SEGMENT_MID)} || text || {_text(rules.SEGMENT_TAIL)} AS prompt
              FROM documents)
            SELECT doc_id, sha256(prompt)[1:16] AS prompt_hash, '<p>1 files, ' || length(prompt) || ' characters</p><ul><li>doc.md: ' ||
              {_strip("regexp_extract(text, '[^.!?' || chr(10) || ']+[.!?]?')")} || '</li></ul>' AS summary,
              CAST(NULL AS VARCHAR) AS error_kind
            FROM d""",
        "q_generate_retry": f"""WITH d AS (
              SELECT *, {_text(rules.SEGMENT_HEAD)} || 'doc.md' || {_text(rules.SEGMENT_MID)} || text || {_text(rules.SEGMENT_TAIL)} AS prompt
              FROM documents), t AS (
              SELECT *, CAST('0x' || md5(prompt)[1] AS INTEGER) % 4 AS tries, md5(prompt)[2] = '0' AS refused FROM d)
            SELECT doc_id, sha256(prompt)[1:16] AS prompt_hash,
              CASE WHEN NOT refused AND tries < 3 THEN
                '<p>attempt ' || tries || '</p><p>1 files, ' || length(prompt) || ' characters</p><ul><li>doc.md: ' ||
                {_strip("regexp_extract(text, '[^.!?' || chr(10) || ']+[.!?]?')")} || '</li></ul>' END AS summary,
              CASE WHEN refused OR tries = 3 THEN 'api' END AS error_kind,
              CASE WHEN refused THEN 'ValueError' WHEN tries = 3 THEN 'TimeoutError' END AS error_detail
            FROM t""",
        "q_history_user": f"""WITH {_HISTORY}
            SELECT id, repository_url, created_at, status, lang, size, technicality FROM history
            WHERE user_id = '{ONE_USER}' ORDER BY created_at DESC, id DESC LIMIT {rules.HISTORY_PAGE}""",
        "q_history_topk": f"""WITH {_HISTORY}
            SELECT user_id, id, created_at, status FROM history WHERE user_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= {rules.HISTORY_PAGE}""",
        "q_topk_salted": f"""WITH {_HISTORY}
            SELECT user_id, id, created_at, status FROM history WHERE user_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= {rules.HISTORY_PAGE}""",
        "q_job_status": f"""WITH {_HISTORY}
            SELECT id AS analysis_id, status, repository_url, lang, size, technicality, summary, error, created_at, updated_at FROM history""",
        "q_detail": f"""WITH {_HISTORY}
            SELECT id, repository_url, created_at, updated_at, lang, size, technicality, summary, status, error FROM history""",
        "q_render": f"""WITH {_HISTORY}
            SELECT id, repository_url, status, '(Status: ' || status || ')' AS status_line,
              'Params: L:' || lang || ', S:' || size || ', T:' || technicality AS params_line,
              'Lang: ' || lang || ', Size: ' || size || ', Tech: ' || technicality AS detail_params,
              CASE status WHEN 'COMPLETED' THEN coalesce(summary, {_text(rules.SUMMARY_MISSING)}) END AS summary_text,
              CASE status WHEN 'FAILED' THEN coalesce(error, {_text(rules.FAILURE_UNKNOWN)}) END AS failure_text,
              CASE WHEN status = 'COMPLETED' THEN coalesce('<h4>Summary:</h4><div class="summary-content-box">' || summary || '</div>', '')
                   WHEN status = 'FAILED' AND error IS NOT NULL THEN '<p class="error"><strong>Error:</strong> ' || error || '</p>'
                   ELSE {_text(rules.DETAIL_PENDING)} END AS detail_body,
              status IN ('COMPLETED', 'FAILED') AS terminal
            FROM history""",
        "q_status_counts": f"""WITH {_HISTORY}
            SELECT status, count(*) AS n, count(summary) AS with_summary, count(error) AS with_error FROM history GROUP BY status""",
        "q_lookup": _LOOKUP_SQL,
        "q_store_lookup": _LOOKUP_SQL,
        "q_bucket_lookup": _LOOKUP_SQL,
        "q_event_validate": f"WITH {_VALID} SELECT seq, analysis_id, status, reject_reason FROM judged",
        "q_fold_events": _FOLD_SQL,
        "q_apply_events": f"""WITH {_FOLDED}, {_HISTORY}
            SELECT h.id, CASE WHEN f.analysis_id IS NULL THEN h.updated_at ELSE f.updated_at END AS updated_at,
              CASE WHEN f.analysis_id IS NULL THEN h.status ELSE f.status END AS status,
              CASE WHEN f.summary_set THEN f.summary ELSE h.summary END AS summary,
              CASE WHEN f.analysis_id IS NULL THEN h.error ELSE f.error END AS error
            FROM history h LEFT JOIN folds f ON f.analysis_id = h.id""",
        "q_orphans": f"""WITH {_FOLDED}, {_HISTORY}
            SELECT analysis_id, status FROM folds WHERE NOT EXISTS (SELECT 1 FROM history WHERE history.id = folds.analysis_id)""",
        "q_stage_events": f"""WITH {_HISTORY}, j AS (
              SELECT *, {_KIND} AS kind, status = 'FAILED' AND {_KIND} IN ('clone', 'internal', 'blank_repository') AS repo_failed FROM history),
            emitted AS (
              SELECT id * 4 AS seq, id AS analysis_id, 'PROCESSING' AS status, {_text(rules.STAGE_STARTED)} AS message,
                CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS error FROM j
              UNION ALL SELECT id * 4 + 1, id, 'FAILED', NULL, NULL, {_error_of('kind', 'error')} FROM j WHERE repo_failed
              UNION ALL SELECT id * 4 + 2, id, 'PROCESSING', NULL, NULL, NULL FROM j WHERE NOT repo_failed AND status <> 'QUEUED'
              UNION ALL SELECT id * 4 + 3, id, 'FAILED', NULL, NULL, {_error_of('kind', 'error')} FROM j WHERE status = 'FAILED' AND NOT repo_failed
              UNION ALL SELECT id * 4 + 3, id, 'COMPLETED', NULL, summary, NULL FROM j WHERE status = 'COMPLETED')
            SELECT * FROM emitted""",
        "q_error_map": f"""WITH {_HISTORY}
            SELECT id, {_error_of(_KIND, "repeat(repository_url || ' ', 20)")} AS error FROM history""",
        "q_tree_scan": f"WITH {_SELECTED} SELECT repo_id, path, file_class, size, md5(content) AS text_md5 FROM selected",
        "q_tree_errors": f"""WITH {_SELECTED}
            SELECT repo_id, path, md5(content) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM selected
            WHERE NOT (path LIKE '%.go' OR path LIKE 'src/m%')
            UNION ALL SELECT repo_id, path, NULL, CASE WHEN path LIKE '%.go' THEN 'FileNotFoundError' ELSE 'OSError' END
            FROM parts WHERE path LIKE '%.go' OR path LIKE 'src/m%'
            UNION ALL SELECT 'none', '.', NULL, 'FileNotFoundError'""",
        "q_history_append": f"WITH {_HISTORY} SELECT * FROM history",
        "q_history_update": f"""WITH {_FOLDED}, {_HISTORY}
            SELECT h.id, user_id, repository_url, created_at, CASE WHEN f.analysis_id IS NULL THEN h.updated_at ELSE f.updated_at END AS updated_at,
              lang, size, technicality, CASE WHEN f.analysis_id IS NULL THEN h.status ELSE f.status END AS status,
              CASE WHEN f.summary_set THEN f.summary ELSE h.summary END AS summary,
              CASE WHEN f.analysis_id IS NULL THEN h.error ELSE f.error END AS error
            FROM history h LEFT JOIN folds f ON f.analysis_id = h.id WHERE h.id % 7 <> 0""",
        "q_queue_drain": f"WITH {_EVENTS} SELECT seq, ts, analysis_id, status, summary, error FROM status_events",
        "q_stream_queue": f"WITH {_EVENTS} SELECT seq, ts, analysis_id, status, summary, error FROM status_events",
        "q_stream_fold": _FOLD_SQL,
        "q_stream_history": f"""WITH {_FOLDED}, {_HISTORY}
            SELECT h.id, h.user_id, h.repository_url, h.created_at, h.lang, h.size, h.technicality,
              CASE WHEN f.analysis_id IS NULL THEN h.updated_at ELSE f.updated_at END AS updated_at,
              CASE WHEN f.analysis_id IS NULL THEN h.status ELSE f.status END AS status,
              CASE WHEN f.summary_set THEN f.summary ELSE h.summary END AS summary,
              CASE WHEN f.analysis_id IS NULL THEN h.error ELSE f.error END AS error
            FROM history h LEFT JOIN folds f ON f.analysis_id = h.id""",
        "q_stream_terminal": f"""WITH {_VALID}
            SELECT DISTINCT analysis_id FROM judged WHERE reject_reason IS NULL AND status IN ('COMPLETED', 'FAILED')""",
        "q_stream_rate_flags": f"""{_FLAGS}
            AND minute + INTERVAL 1 MINUTE <= (SELECT max(created_at) FROM history) - INTERVAL 2 MINUTE""",
        "q_run_briefs": f"""WITH {_BRIEFED}, {_HISTORY}
            SELECT (SELECT max(id) FROM history) + place AS id, url AS repository_url, lang, size, technicality,
              CASE WHEN text IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status,
              md5({_EXTRACT}) AS summary_md5,
              CASE WHEN text IS NULL THEN {_text(rules.BLANK_REPOSITORY)} END AS error
            FROM briefed""",
        "q_stream_briefs": f"""WITH {_BRIEFED}
            SELECT place AS id, url AS repository_url, lang, size, technicality,
              CASE WHEN text IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, md5({_EXTRACT}) AS summary_md5,
              CASE WHEN text IS NULL THEN {_text(rules.BLANK_REPOSITORY)} END AS error
            FROM briefed""",
        "q_stream_rejects": f"""WITH {_CHECKED}, {_VALID}
            SELECT 'request' AS kind, request_id AS id, reject_reason FROM checked WHERE reject_reason IS NOT NULL
            UNION ALL SELECT 'event', seq, reject_reason FROM judged WHERE reject_reason IS NOT NULL""",
        "q_ai_stage": f"""WITH {_OUTPUTS}, {_GUIDES}, k AS (
              SELECT conv_id * 1000 + turn + 1 AS id, (conv_id + turn) % 7 AS kind, text AS words, 'en' AS lang,
                CASE WHEN (conv_id + turn) % 7 = 1 THEN 'small' ELSE 'medium' END AS size, 'expert' AS technicality FROM model_outputs),
            given AS (
              SELECT g.*, {_text(rules.SEGMENT_HEAD)} || 'turn.md' || {_text(rules.SEGMENT_MID)} || words || {_text(rules.SEGMENT_TAIL)} AS text
              FROM ({_guided('k')}) AS g),
            asked AS (SELECT *, {_prompt('lang', 'length_guidance', 'audience_guidance', 'text')} AS prompt FROM given)
            SELECT id * 4 + 2 AS seq, id AS analysis_id, 'PROCESSING' AS status, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS error
            FROM k WHERE kind <> 5
            UNION ALL SELECT id * 4 + 3, id, 'FAILED', NULL, {_text(rules.BLANK_AI_TEXT)} FROM k WHERE kind = 3
            UNION ALL SELECT id * 4 + 3, id, 'COMPLETED', {_EXTRACT}, NULL FROM asked WHERE kind NOT IN (3, 5)
            UNION ALL SELECT NULL, 0, 'REJECTED', NULL, 'missing analysis_id' FROM k WHERE kind = 5""",
    }

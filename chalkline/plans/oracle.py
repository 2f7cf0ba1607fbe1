"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark plans (windows, ``string_agg`` and list
lambdas where Spark uses aggregates and joins), from the same fixed values
and salt lists. The driver tables are pre-registered views.
"""

from __future__ import annotations

from chalkline.functions import rules as R
from chalkline.functions.content import DEVANAGARI_CLASS
from chalkline.functions.templates import TASK_TEMPLATES, template_parts
from chalkline.functions.textops import WS_CLASS, sql_str
from chalkline.plans import salt as S

WS = sql_str(R.PY_WHITESPACE)
NL = "chr(10)"
CAM = sql_str(R.SOURCE_CAMERA)


# --------------------------------------------------------------------------- SQL builders
def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else sql_str(v) for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"{lst(values)}[({idx}) + 1]"


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def any_contains(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {sql_str(w)})" for w in words) + ")"


def any_starts(e: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({e}, {sql_str(w)})" for w in words) + ")"


def blank(e: str) -> str:
    return f"({e} IS NULL OR {strip(e)} = '')"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def normalize(e: str) -> str:
    out = strip(e)
    for phrase, repl in R.NORMALIZE_REWRITES:
        out = f"regexp_replace({out}, {sql_str(chr(92) + 'b' + phrase + chr(92) + 'b')}, {sql_str(repl)}, 'gi')"
    return f"(CASE WHEN {e} IS NULL OR {e} = '' THEN {e} ELSE {out} END)"


def specific(e: str) -> str:
    m = f"coalesce({e}, '')"
    low = strip(f"lower({m})")
    tokens = f"(CASE WHEN {low} = '' THEN 0 ELSE len(string_split_regex({low}, {sql_str(WS_CLASS + '+')})) END)"
    return (f"(length({strip(m)}) >= 3 AND (contains({m}, '?') OR {any_contains(low, R.QUESTION_WORDS)}) "
            f"AND NOT ({any_starts(low, R.GENERIC_GREETINGS)} AND {tokens} <= 3))")


def help_type(e: str) -> str:
    low = f"lower(coalesce({e}, ''))"
    return (f"(CASE WHEN {any_contains(low, R.HELP_TERMS_WORDS)} THEN 'terms' "
            f"WHEN {any_contains(low, R.HELP_SOLUTION_WORDS)} THEN 'solution' "
            f"WHEN {any_contains(low, R.HELP_EXPLANATION_WORDS)} THEN 'explanation' ELSE 'general' END)")


def fallback(subject: str, q: str) -> str:
    low = f"lower(coalesce({q}, ''))"
    return (f"(CASE WHEN {any_contains(low, R.VOCAB_KEYWORDS)} THEN {sql_str(R.VOCAB_REPLY)} ELSE "
            f"{sql_str(R.REDIRECT_REPLY_HEAD)} || coalesce({subject}, 'None') || {sql_str(R.REDIRECT_REPLY_TAIL)} END)")


def chapter_int(e: str) -> str:
    return f"(CASE WHEN regexp_full_match({e}, '[0-9]+') THEN coalesce(nullif(TRY_CAST({e} AS BIGINT), 0), 1) ELSE 1 END)"


def route_source(e: str) -> str:
    return (f"(CASE WHEN {e} = {sql_str(R.SOURCE_UPLOAD)} THEN 'upload' WHEN {e} = {CAM} THEN 'camera' "
            f"ELSE 'chapter' END)")


def coerce(f: str) -> str:
    return f"(CASE WHEN {f} IS NULL THEN NULL ELSE coalesce(nullif({f}.path, ''), nullif({f}.name, ''), {f}.orig_name) END)"


def suffix(p: str) -> str:
    return f"regexp_extract(regexp_extract({p}, '([^/]*)/*$', 1), '^.+(\\.[^.]+)$', 1)"


def admit(p: str, strict: bool = False) -> str:
    ext = f"lower({suffix(p)})"
    if strict:
        return f"(CASE WHEN {ext} = '.pdf' THEN 'pdf' ELSE 'unsupported' END)"
    return (f"(CASE WHEN {ext} = '.pdf' THEN 'pdf' WHEN {ext} IN ({', '.join(map(sql_str, R.IMAGE_SUFFIXES))}) "
            f"THEN 'image' ELSE 'unsupported' END)")


def tool_error(e: str) -> str:
    return f"({e} IS NULL OR {e} = '' OR coalesce({any_contains(e, R.TOOL_ERROR_MARKERS)}, false))"


def content_info(text: str, legacy: bool = False) -> dict:
    subjects = R.LEGACY_CONTENT_SUBJECTS if legacy else R.CONTENT_SUBJECTS
    hw = R.LEGACY_HOMEWORK_WORDS if legacy else R.HOMEWORK_WORDS
    tb = R.LEGACY_TEXTBOOK_WORDS if legacy else R.TEXTBOOK_WORDS
    qi = R.LEGACY_QUESTION_INDICATORS if legacy else R.QUESTION_INDICATORS
    ex = R.LEGACY_EXERCISE_INDICATORS if legacy else R.EXERCISE_INDICATORS
    low = f"lower(coalesce({text}, ''))"
    subj = "(CASE " + " ".join(f"WHEN {any_contains(low, ws)} THEN {sql_str(n)}" for n, ws in subjects) + \
        " ELSE 'unknown' END)"
    is_hw, is_tb = any_contains(low, hw), any_contains(low, tb)
    return {
        "type": f"(CASE WHEN {is_hw} THEN 'homework' WHEN {is_tb} THEN 'textbook' ELSE 'general' END)",
        "subject": subj,
        "has_questions": any_contains(low, qi),
        "has_exercises": any_contains(low, ex),
        "confidence": (f"(CASE WHEN {is_hw} THEN {dbl(0.9)} WHEN {is_tb} THEN {dbl(0.8)} "
                       f"WHEN {subj} <> 'unknown' THEN {dbl(0.8)} ELSE {dbl(0.5)} END)"),
    }


def lang_counts(text: str) -> tuple[str, str]:
    t = f"coalesce({text}, '')"
    dev = f"(length({t}) - length(regexp_replace({t}, {sql_str(DEVANAGARI_CLASS)}, '', 'g')))"
    letters = f"(length({t}) - length(regexp_replace({t}, '\\p{{L}}', '', 'g')))"
    return dev, letters


def language(text: str) -> str:
    dev, letters = lang_counts(text)
    return f"(CASE WHEN {letters} > 0 AND {dev} * 10 > {letters} * 3 THEN 'hi' ELSE 'en' END)"


def json_str(e: str) -> str:
    """A JSON string as Python's json.dumps(ensure_ascii=True) writes it."""
    per_char = ("lambda c: CASE WHEN c = '\\' THEN '\\\\' WHEN c = '\"' THEN '\\\"' "
                "WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' "
                "WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' "
                "WHEN unicode(c) BETWEEN 32 AND 126 THEN c "
                "WHEN unicode(c) > 65535 THEN '\\u' || printf('%04x', 55296 + ((unicode(c) - 65536) // 1024)) "
                "|| '\\u' || printf('%04x', 56320 + ((unicode(c) - 65536) % 1024)) "
                "ELSE '\\u' || printf('%04x', unicode(c)) END")
    esc = f"array_to_string(list_transform(string_split({e}, ''), {per_char}), '')"
    return (f"(CASE WHEN {e} IS NULL THEN 'null' ELSE '\"' || (CASE WHEN regexp_matches({e}, '[^\\x20-\\x7e]|[\"\\\\]') "
            f"THEN {esc} ELSE {e} END) || '\"' END)")


def cache_key(intent, subject, chapter, source, query, doc_hash) -> str:
    parts = [f"'{{\"chapter_number\":' || CAST({chapter} AS VARCHAR)",
             f"',\"content_source\":' || {json_str(source)}",
             f"',\"document_hash\":' || {json_str(doc_hash)}",
             f"',\"intent\":' || {json_str(intent)}",
             f"',\"student_query\":' || {json_str(f'coalesce({query}, {sql_str('')})')}",
             f"',\"subject\":' || {json_str(subject)}", "'}'"]
    return "sha256(" + " || ".join(parts) + ")"


# --------------------------------------------------------------------------- input CTEs
def cte_requests() -> str:
    fname = pick(S.FILE_NAMES, "conv_id % 9")
    fpath = f"('uploads/' || CAST(conv_id AS VARCHAR) || '/' || {fname})"
    ev = f"(conv_id * {S.EVENT_ID_MULT} + turn)"
    file = (f"CASE conv_id % 4 WHEN 1 THEN {{'path': {fpath}, 'name': {fpath}, 'orig_name': {fname}}} "
            f"WHEN 2 THEN {{'path': '', 'name': {fpath}, 'orig_name': {fname}}} "
            f"WHEN 3 THEN {{'path': CAST(NULL AS VARCHAR), 'name': '', 'orig_name': {fname}}} END")
    msg = f"CASE WHEN role = 'system' THEN '' ELSE {pick(S.QUESTION_PHRASES, ev + ' % 10')} || ' ' || coalesce(text, '') END"
    return (f"requests AS (SELECT conv_id AS session_id, "
            f"{S.EPOCH_2024} + turn * {S.TURN_SECONDS} + (conv_id * {S.SESSION_OFFSET_MULT}) % {S.TURN_SECONDS} AS ts, "
            f"{ev} AS event_id, {pick(S.SUBJECT_CHOICES, 'conv_id % 5')} AS subject, "
            f"{pick(S.CHAPTER_CHOICES, 'conv_id % 14')} AS chapter, "
            f"{pick(S.SOURCE_CHOICES, '(conv_id // 5) % 3')} AS content_source, {file} AS file, "
            f"{msg} AS message, turn AS conv_turn FROM conversations WHERE role IN ('user', 'system'))")


def cte_uploads() -> str:
    return (f"uploads AS (SELECT page_id, 'uploads/' || CAST(page_id AS VARCHAR) || '/' || "
            f"{pick(S.FILE_NAMES, 'page_id % 9')} AS path, coalesce(html, '') AS html FROM pages)")


def cte_routed() -> str:
    """requests -> hash lookup -> turn numbers -> intent -> cache query -> key, then replies."""
    intent = (f"CASE WHEN turn = 1 AND NOT {blank('message')} AND {specific('message')} THEN 'smart_first_response' "
              f"WHEN turn = 1 OR ({blank('message')} AND (content_source IS NULL OR content_source <> {CAM})) "
              f"THEN 'greeting' ELSE 'follow_up' END")
    return ", ".join([
        cte_requests(), cte_uploads(),
        f"hashed AS (SELECT r.*, u.document_hash FROM (SELECT *, {coerce('file')} AS file_path FROM requests) r "
        f"LEFT JOIN (SELECT path, sha256(html) AS document_hash FROM uploads) u ON r.file_path = u.path)",
        "numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS INTEGER) "
        "AS turn FROM hashed)",
        f"intents AS (SELECT *, {intent} AS intent, {chapter_int('chapter')} AS chapter_no FROM numbered)",
        f"queried AS (SELECT *, CASE WHEN intent = 'greeting' THEN '' WHEN message IS NULL OR message = '' THEN '' "
        f"ELSE {normalize('message')} END AS cache_query FROM intents)",
        f"routed AS (SELECT *, {cache_key('intent', 'subject', 'chapter_no', 'content_source', 'cache_query', 'document_hash')} "
        f"AS key FROM queried)",
        "replies AS (SELECT conv_id AS session_id, turn - 1 AS conv_turn, "
        "CASE WHEN role = 'assistant' THEN text END AS reply FROM conversations)",
        "log AS (SELECT routed.*, replies.reply, coalesce(replies.reply, '') AS response FROM routed "
        "LEFT JOIN replies ON routed.session_id = replies.session_id AND routed.conv_turn = replies.conv_turn)",
        "entries AS (SELECT key, reply AS text, event_id AS version, conv_turn FROM log WHERE reply IS NOT NULL)",
        "idx AS (SELECT key, text, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) "
        "AS rn FROM entries) WHERE rn = 1)",
        f"turns AS (SELECT session_id, turn, CASE WHEN message IS NULL OR message = '' THEN "
        f"{sql_str(R.EMPTY_MESSAGE_DISPLAY)} ELSE message END AS \"user\", response AS teacher, "
        f"CASE WHEN reply IS NOT NULL THEN 'store/audio/' || key || '.mp3' END AS audio FROM log)",
    ])


def cte_content_documents() -> str:
    return (f"content_documents AS (SELECT doc_id, {pick(S.CONTENT_PHRASES, 'doc_id % 10')} || ' ' || "
            f"coalesce(text, '') AS text FROM documents)")


def cte_lines() -> str:
    return ("lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS INTEGER) "
            "AS page_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)")


def cte_candidates() -> str:
    def cand(pos, lang, expr):
        return f"{{'pos': {pos}, 'lang': '{lang}', 'text': {strip(expr)}}}"
    hindi = "regexp_replace(line, '[A-Za-z]', '', 'g')"
    english = "regexp_replace(line, '[^\\x00-\\x7F]', '', 'g')"
    combined = "CASE WHEN (doc_id + page_no) % 4 <> 0 THEN line END"
    return (f"cands AS (SELECT doc_id, page_no, failed, c.pos AS pos, c.lang AS lang, c.text AS text FROM "
            f"(SELECT doc_id, page_no, ((doc_id * 3 + page_no) % 29) = 0 AS failed, "
            f"unnest([{cand(0, 'hindi', hindi)}, {cand(1, 'english', english)}, {cand(2, 'combined', combined)}]) AS c "
            f"FROM lines) WHERE c.text IS NOT NULL AND c.text <> '')")


def cte_picked() -> str:
    pref = "(lang IN ('hindi', 'combined') AND length(text) > 20)"
    return (f"picked AS (SELECT doc_id, page_no, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no "
            f"ORDER BY CASE WHEN {pref} THEN 0 ELSE 1 END, CASE WHEN {pref} THEN pos ELSE -length(text) END, pos) AS rn "
            f"FROM cands) WHERE rn = 1)")


# --------------------------------------------------------------------------- queries
def q_document_profile() -> str:
    ci = content_info("text")
    return (f"WITH {cte_content_documents()}, x AS (SELECT {ci['subject']} AS subject, {ci['type']} AS type, "
            f"{language('text')} AS language, {ci['has_questions']} AS hq, {ci['has_exercises']} AS he, "
            f"{ci['confidence']} AS conf FROM content_documents) "
            f"SELECT subject, type, language, count(*) AS n_docs, CAST(sum(CAST(hq AS INTEGER)) AS BIGINT) AS n_with_questions, "
            f"CAST(sum(CAST(he AS INTEGER)) AS BIGINT) AS n_with_exercises, "
            f"CAST(sum(CAST(round(conf * 10) AS INTEGER)) AS BIGINT) AS confidence_tenths FROM x GROUP BY ALL")


def q_content_type(legacy: bool = False) -> str:
    ci = content_info("text", legacy)
    return (f"WITH {cte_content_documents()} SELECT doc_id, {ci['type']} AS type, {ci['subject']} AS subject, "
            f"{ci['has_questions']} AS has_questions, {ci['has_exercises']} AS has_exercises, "
            f"{ci['confidence']} AS confidence FROM content_documents")


def q_detect_language() -> str:
    n = "CAST((length(text) // 16) * ((doc_id // 6) % 3) AS INTEGER)"
    dev, letters = lang_counts("text")
    return (f"WITH ld AS (SELECT doc_id, repeat({pick(S.LANGUAGE_PHRASES, 'doc_id % 6')} || ' ', {n}) || "
            f"coalesce(text, '') AS text FROM documents) SELECT doc_id, {language('text')} AS language, "
            f"CAST({dev} AS INTEGER) AS n_devanagari, CAST({letters} AS INTEGER) AS n_letters FROM ld")


def q_question_rules() -> str:
    fp = coerce("file")
    return (f"WITH {cte_requests()} SELECT event_id, {normalize('message')} AS normalized, "
            f"{specific('message')} AS is_specific, {help_type('message')} AS help_type, "
            f"{fallback('subject', 'message')} AS fallback, {chapter_int('chapter')} AS chapter_no, "
            f"{route_source('content_source')} AS source_route, {fp} AS file_path, {admit(fp)} AS upload_kind, "
            f"{admit(fp, True)} AS strict_kind, {tool_error('message')} AS is_tool_error FROM requests")


def q_number_turns() -> str:
    return (f"WITH {cte_requests()} SELECT session_id, event_id, CAST(row_number() OVER "
            f"(PARTITION BY session_id ORDER BY ts, event_id) AS INTEGER) AS turn FROM requests")


def q_route_requests() -> str:
    missing = "(file_path IS NULL OR file_path = '')"
    prompt = (f"CASE WHEN content_source = {CAM} AND {missing} AND intent = 'greeting' THEN "
              f"{sql_str(R.CAMERA_PROMPT_GREETING)} WHEN content_source = {CAM} AND {missing} THEN "
              f"{sql_str(R.CAMERA_PROMPT_QUESTION)} WHEN content_source = {sql_str(R.SOURCE_UPLOAD)} AND {missing} "
              f"THEN {sql_str(R.NOT_FOUND_HEAD + R.NO_PDF_UPLOADED)} END")
    return (f"WITH {cte_routed()} SELECT session_id, event_id, turn, intent, chapter_no, cache_query, document_hash, "
            f"key, {prompt} AS prompt FROM routed")


def q_cache_replay() -> str:
    w = "OVER (PARTITION BY key ORDER BY ts, event_id)"
    return (f"WITH {cte_routed()} SELECT event_id, key, row_number() {w} > 1 AS hit, "
            f"first_value(response) {w} AS served_text FROM log")


def q_cache_lookup() -> str:
    return (f"WITH {cte_routed()} SELECT r.event_id, r.key, idx.key IS NOT NULL AS hit, idx.text AS cached_text "
            f"FROM routed r LEFT JOIN idx ON r.key = idx.key")


def q_upsert_responses() -> str:
    return (f"WITH {cte_routed()}, both_ AS (SELECT key, text, version, CASE WHEN conv_turn < {S.INDEX_CUTOFF_TURN} "
            f"THEN 0 ELSE 1 END AS rk FROM entries) SELECT key, text, version FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY key ORDER BY version DESC, rk DESC) AS rn FROM both_) WHERE rn = 1")


def q_audio_plan() -> str:
    src = "CASE version % 3 WHEN 0 THEN NULL WHEN 1 THEN '/tmp/tts/a.wav' ELSE '/tmp/tts/noext' END"
    path = (f"CASE WHEN src IS NULL OR src = '' THEN src ELSE 'store/audio/' || key || "
            f"CASE WHEN {suffix('src')} = '' THEN '.mp3' ELSE {suffix('src')} END END")
    return (f"WITH {cte_routed()}, a AS (SELECT key, text, {src} AS src FROM idx) SELECT key, {path} AS audio_path, "
            f"(coalesce(text <> '', false) AND (src IS NULL OR src = '')) AS needs_audio FROM a")


def clean_sql(raw: str) -> str:
    """T2 as nested SQL over the column ``raw``."""
    thought = lambda e: any_contains(f"lower({e})", R.THOUGHT_PATTERNS)
    lines = (f"list_filter(list_transform(string_split({raw}, {NL}), lambda x: {strip('x')}), lambda x: x <> '' "
             f"AND NOT {thought('x')} AND NOT {any_starts('lower(x)', R.REASONING_PREFIXES)})")
    c = strip(f"array_to_string({lines}, {NL})")
    c = f"regexp_replace({c}, {sql_str('Thought:' + WS_CLASS + '*')}, '', 'gi')"
    c = f"regexp_replace({c}, {sql_str(chr(92) + 'bThought' + chr(92) + 'b[:' + WS_CLASS[1:-1] + ']*')}, '', 'gi')"
    c = strip(f"regexp_replace({c}, {sql_str(chr(10) + WS_CLASS + '*' + chr(10) + WS_CLASS + '*' + chr(10))}, "
              f"{NL} || {NL}, 'g')")
    paras = (f"list_filter(list_transform(string_split({raw}, {NL} || {NL}), lambda p: {strip('p')}), "
             f"lambda p: p <> '')")
    good = f"list_filter(list_reverse({paras}), lambda p: NOT {thought('p')} AND length(p) > 20)[1]"
    return (f"(CASE WHEN {raw} IS NULL OR {raw} = '' THEN '' ELSE (SELECT CASE WHEN length(r) < 10 THEN "
            f"{sql_str(R.CLEAN_FALLBACK)} ELSE r END FROM (SELECT CASE WHEN length(c) < 20 THEN coalesce({good}, c) "
            f"ELSE c END AS r FROM (SELECT {c} AS c))) END)")


def default_reply(question: str) -> str:
    """T12 over the columns flow, cleaned and subject."""
    marker = sql_str(R.TOOL_MARKER)
    return (f"CASE WHEN flow = 'greeting' AND (cleaned = '' OR contains(cleaned, {marker})) THEN "
            f"{sql_str(R.GREETING_DEFAULT_HEAD)} || coalesce(subject, 'None') || {sql_str(R.GREETING_DEFAULT_TAIL)} "
            f"WHEN flow IN ('smart_first_response', 'follow_up') AND contains(lower(cleaned), {marker}) THEN "
            f"{fallback('subject', question)} "
            f"WHEN flow IN ('smart_first_response', 'follow_up', 'camera_follow_up') AND cleaned = '' THEN "
            f"{sql_str(R.CLARIFY_DEFAULT)} WHEN flow = 'camera_first' AND cleaned = '' THEN "
            f"{sql_str(R.CAMERA_EMPTY_DEFAULT)} ELSE cleaned END")


SPEECH_LANG = ("CASE WHEN flow = 'camera_first' THEN CASE WHEN contains(lower(coalesce(reply, '')), 'hindi') THEN 'hi' "
               "ELSE 'en' END WHEN flow = 'document_question' THEN 'en' WHEN lower(subject) = 'hindi' THEN 'hi' ELSE 'en' END")


def q_store_answers() -> str:
    ctes = [cte_routed(),
            f"a AS (SELECT key, subject, message, event_id, conv_turn, {pick(S.ANSWER_PHRASES, '(event_id + 1) % 6')} || reply AS raw, "
            f"CASE WHEN content_source = {CAM} THEN CASE WHEN intent <> 'follow_up' THEN 'camera_first' ELSE 'camera_follow_up' END "
            "ELSE intent END AS flow FROM log WHERE reply IS NOT NULL)",
            f"b AS (SELECT *, {clean_sql('raw')} AS cleaned FROM a)", f"c AS (SELECT *, {default_reply('message')} AS reply FROM b)",
            "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS rn FROM c) WHERE rn = 1)",
            "s AS (SELECT *, reply AS t FROM e)"]
    last = "s"
    for i, step in enumerate(speech_sql("live")):
        ctes.append(f"s{i} AS (SELECT * REPLACE ({step} AS t) FROM {last})")
        last = f"s{i}"
    return (f"WITH {', '.join(ctes)} SELECT key, reply AS text, 'store/audio/' || key || '.wav' AS audio_path, event_id AS version, "
            f"{SPEECH_LANG} AS speech_lang, t AS speech FROM {last}")


def q_clean_answers() -> str:
    ev = f"(conv_id * {S.EVENT_ID_MULT} + turn)"
    flows = ["greeting", "smart_first_response", "follow_up", "camera_first", "camera_follow_up"]
    marker = sql_str(R.TOOL_MARKER)
    return (f"WITH a AS (SELECT conv_id AS session_id, {ev} AS event_id, "
            f"{pick(S.ANSWER_PHRASES, ev + ' % 6')} || coalesce(text, '') AS raw, "
            f"(SELECT any_value(q.text) FROM conversations q WHERE q.role = 'user' AND q.conv_id = c.conv_id AND "
            f"q.turn = c.turn - 1) AS question FROM conversations c "
            f"WHERE role = 'assistant'), b AS (SELECT event_id, raw, question, {pick(S.SUBJECT_CHOICES, 'session_id % 5')} AS subject, "
            f"{pick(flows, 'event_id % 5')} AS flow FROM a), c AS (SELECT *, {clean_sql('raw')} AS cleaned FROM b), "
            f"d AS (SELECT *, {default_reply('question')} AS reply FROM c) SELECT event_id, flow, cleaned, "
            f"contains(lower(coalesce(cleaned, '')), {marker}) AS has_marker, {tool_error('raw')} AS is_tool_error, "
            f"reply, {SPEECH_LANG} AS speech_lang FROM d")


def speech_sql(variant: str, preserve: bool = False) -> list[str]:
    """T3 as successive projections of a column ``t`` (one per step)."""
    o, c = "\ue000", "\ue001"
    inner = f"[^{o}{c}]"
    ws = WS_CLASS
    steps = []
    strip_pat = r"\*\*|\*|__|~~|`|–|-" if variant == "live" else r"\*\*|\*|__|~~|`|-"
    steps.append(f"regexp_replace(t, {sql_str(strip_pat)}, '', 'g')")
    if variant == "live" or not preserve:
        steps.append(f"regexp_replace(t, {sql_str(r'\(([^()' + chr(10) + r']+)\)')}, {sql_str(o + chr(92) + '1' + c)}, 'g')")
        steps.append(f"regexp_replace(t, {sql_str(o + ws + '*' + c)}, '', 'g')")
        steps.append(f"regexp_replace(t, {sql_str(o + ws + '*(' + inner + '*?[.!?])' + ws + '*' + c)}, "
                     f"{sql_str('. ' + chr(92) + '1 ')}, 'g')")
        steps.append(f"regexp_replace(t, {sql_str(o + ws + '*(' + inner + '*?)' + ws + '*' + c)}, "
                     f"{sql_str('. ' + chr(92) + '1. ')}, 'g')")
    steps.append(f"regexp_replace(t, {sql_str(r'(\p{Nd}+\.' + ws + r'*)([^' + chr(10) + r']+)')}, "
                 f"{sql_str(chr(92) + '1' + chr(92) + '2.')}, 'g')")
    steps.append(f"regexp_replace(t, {sql_str('(English meaning:[^' + chr(10) + ']*?)' + chr(10))}, "
                 f"{sql_str(chr(92) + '1. ')}, 'g')")
    steps.append(f"array_to_string(list_transform(string_split(t, {NL}), lambda x, i: CASE WHEN i = "
                 f"len(string_split(t, {NL})) THEN x WHEN regexp_matches(x, ':.') THEN {strip('x')} || CASE WHEN "
                 f"regexp_matches({strip('x')}, '[.!?]$') THEN ' ' ELSE '. ' END ELSE x || {NL} END), '')")
    steps.append(f"regexp_replace(t, {sql_str(ws + '-' + ws)}, '. ', 'g')")
    bullets = r"[\*\-•]" if variant == "live" else r"[\*\->]"
    steps.append(f"regexp_replace(t, {sql_str(chr(10) + ws + '*' + bullets + ws + '*')}, '. ', 'g')")
    steps.append(f"regexp_replace(t, {sql_str(ws + '{2,}')}, ' ', 'g')")
    steps.append(strip(f"replace(t, {NL}, ' ')"))
    return steps


def q_speech_text() -> str:
    ev = f"(conv_id * {S.EVENT_ID_MULT} + turn)"
    ctes = [f"s0 AS (SELECT {ev} AS event_id, {pick(S.SPEECH_PHRASES, ev + ' % 7')} || coalesce(text, '') AS t "
            f"FROM conversations WHERE role = 'assistant')"]
    outs = []
    for name, variant, keep in (("live", "live", False), ("legacy", "legacy", False), ("legacy_keep", "legacy", True)):
        prev = "s0"
        for i, step in enumerate(speech_sql(variant, keep)):
            cur = f"{name}_{i}"
            ctes.append(f"{cur} AS (SELECT event_id, {step} AS t FROM {prev})")
            prev = cur
        outs.append((name, prev))
    sel = ", ".join(f"{o[1]}.t AS {o[0]}" for o in outs)
    joins = " ".join(f"JOIN {o[1]} USING (event_id)" for o in outs[1:])
    return f"WITH {', '.join(ctes)} SELECT event_id, {sel} FROM {outs[0][1]} {joins}"


def q_pair_turns() -> str:
    return ("SELECT u.conv_id, u.turn, u.text AS \"user\", CASE WHEN n.role = 'assistant' THEN n.text END AS teacher "
            "FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 "
            "WHERE u.role = 'user'")


def q_render_transcript() -> str:
    sep = sql_str(R.TRANSCRIPT_SEPARATOR)
    block = (f"{sql_str(R.TRANSCRIPT_TURN_HEAD)} || CAST(turn AS VARCHAR) || {sep} || {sql_str(R.TRANSCRIPT_USER_HEAD)} "
             f"|| coalesce(\"user\", '') || {sep} || {sql_str(R.TRANSCRIPT_TEACHER_HEAD)} || coalesce(teacher, '')")
    return (f"WITH {cte_routed()} SELECT session_id, CAST((turn - 1) // 100 AS INTEGER) AS page, count(*) AS n_turns, "
            f"string_agg({block}, {sep} ORDER BY turn) AS transcript FROM turns GROUP BY session_id, (turn - 1) // 100")


def q_transcript_lines() -> str:
    return (f"WITH {cte_routed()} "
            f"SELECT session_id, turn, 1 AS line_no, {sql_str(R.TRANSCRIPT_TURN_HEAD)} || CAST(turn AS VARCHAR) AS line FROM turns "
            f"UNION ALL SELECT session_id, turn, 2, {sql_str(R.TRANSCRIPT_USER_HEAD)} || coalesce(\"user\", '') FROM turns "
            f"UNION ALL SELECT session_id, turn, 3, {sql_str(R.TRANSCRIPT_TEACHER_HEAD)} || coalesce(teacher, '') FROM turns")


def q_replay_turn() -> str:
    labels = ["Turn 1", "Turn 2", "Turn 0", "Turn 9", "abc", None, " Turn 3 "]
    idx = f"TRY_CAST({strip('replace(p.label, ' + sql_str(R.TURN_LABEL_HEAD) + ', ' + sql_str('') + ')')} AS INTEGER)"
    return (f"WITH {cte_routed()}, p AS (SELECT session_id, event_id, {pick(labels, 'event_id % 7')} AS label FROM requests) "
            f"SELECT p.event_id, p.label, coalesce(t.teacher, '') AS replay_text, t.audio AS replay_audio FROM p "
            f"LEFT JOIN turns t ON t.session_id = p.session_id AND t.turn = {idx}")


def q_quick_actions() -> str:
    case = "CASE action " + " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in R.QUICK_ACTIONS) + " END"
    return (f"WITH {cte_requests()}, a AS (SELECT event_id, {pick(S.ACTION_CODES, 'event_id % 4')} AS action "
            f"FROM requests) SELECT event_id, action, {case} AS message, ({case}) IS NOT NULL AS accepted FROM a")


def cte_current_document(base: bool = True) -> str:
    """A document that replaces counts as the last one so far, one stored only where there is none as the first so far."""
    def seen(agg: str, column: str, keep: str) -> str:
        return (f"{agg}(CASE WHEN {keep} THEN {column} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id, kind "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

    def state(column: str) -> str:
        return f"coalesce({seen('last_value', column, 'NOT if_none')}, {seen('first_value', column, 'if_none')})"

    return ", ".join([
        *([cte_requests(), cte_uploads()] if base else []),
        f"r AS (SELECT session_id, ts, event_id, {coerce('file')} AS file_path, content_source, message, "
        "row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) > 1 AS later FROM requests)",
        f"d AS (SELECT session_id, ts, event_id, file_path, later FROM r WHERE content_source = {CAM} AND "
        f"{admit('file_path')} <> 'unsupported' AND file_path IN (SELECT path FROM uploads WHERE {strip('html')} <> ''))",
        "u AS (SELECT session_id, ts, event_id, 1 AS kind, CAST(NULL AS BIGINT) AS de, CAST(NULL AS VARCHAR) AS dp, false AS if_none "
        "FROM r UNION ALL SELECT session_id, ts, event_id, 0, event_id, file_path, later FROM d)",
        f"seen AS (SELECT *, {state('de')} AS doc_event_id, {state('dp')} AS doc_path FROM u)",
        "cd AS (SELECT event_id, doc_event_id, doc_path FROM seen WHERE kind = 1)",
    ])


def q_current_document() -> str:
    return f"WITH {cte_current_document()} SELECT event_id, doc_event_id, doc_path FROM cd"


def q_document_answers() -> str:
    reply = "CASE " + " ".join(
        f"WHEN ht = {sql_str(k)} THEN {sql_str(h)} || coalesce(message, '') || {sql_str(t)}"
        for k, (h, t) in R.HELP_TEMPLATES.items()) + " END"
    gate = (f"CASE WHEN {blank('message')} THEN {sql_str(R.BLANK_DOCUMENT_QUESTION_REPLY)} WHEN doc_event_id IS NULL "
            f"THEN {sql_str(R.NO_DOCUMENT_REPLY)} ELSE {reply} END")
    return (f"WITH {cte_current_document()}, x AS (SELECT r.event_id, r.message, cd.doc_event_id, "
            f"{help_type('r.message')} AS ht FROM r JOIN cd USING (event_id)) "
            f"SELECT event_id, ht AS help_type, {gate} AS reply FROM x")


def q_upgrade_history() -> str:
    return (f"WITH {cte_routed()} SELECT session_id, turn, \"user\", teacher, CASE WHEN session_id % 2 = 0 THEN NULL "
            f"ELSE audio END AS audio FROM turns")


def cte_pages() -> str:
    return (f"{cte_lines()}, pages AS (SELECT doc_id, page_no, CASE WHEN doc_id % 7 = 0 THEN '' ELSE line END AS text "
            f"FROM lines)")


def regular_agg() -> str:
    return strip(f"coalesce(string_agg(text || {NL}, '' ORDER BY page_no) FILTER (WHERE text <> ''), '')")


def q_assemble_pages() -> str:
    chapter = "coalesce(string_agg(text, '' ORDER BY page_no) FILTER (WHERE text <> ''), '')"
    upload = strip(f"coalesce(string_agg(text, {NL} ORDER BY page_no) FILTER (WHERE text <> ''), '')")
    return (f"WITH {cte_lines()}, pages AS (SELECT doc_id, page_no, line AS text FROM lines) "
            f"SELECT doc_id, sha256({chapter}) AS chapter_sha, sha256({upload}) AS upload_sha, "
            f"{regular_agg()} AS regular_text FROM pages GROUP BY doc_id")


def q_pick_ocr_text() -> str:
    return f"WITH {cte_lines()}, {cte_candidates()}, {cte_picked()} SELECT doc_id, page_no, lang, text FROM picked"


def cte_ocr_pages() -> str:
    return ("ocr_pages AS (SELECT doc_id, page_no, ((doc_id * 3 + page_no) % 29) = 0 AS failed FROM lines), "
            "first_fail AS (SELECT doc_id, min(page_no) AS ff FROM ocr_pages WHERE failed GROUP BY doc_id), "
            "kept AS (SELECT o.doc_id, o.page_no FROM ocr_pages o LEFT JOIN first_fail f USING (doc_id) "
            "WHERE f.ff IS NULL OR o.page_no < f.ff)")


def q_truncate_at_failure() -> str:
    return (f"WITH {cte_lines()}, {cte_ocr_pages()} SELECT doc_id, count(*) AS n_pages_kept, max(page_no) AS last_page "
            f"FROM kept GROUP BY doc_id")


def cte_extraction() -> str:
    ocr_page = (f"{sql_str(R.OCR_PAGE_HEAD)} || CAST(k.page_no AS VARCHAR) || {sql_str(R.OCR_PAGE_TAIL)} || "
                f"coalesce(p.text, '') || {NL}")
    return (f"{cte_pages()}, {cte_candidates()}, {cte_picked()}, {cte_ocr_pages()}, "
            f"reg AS (SELECT doc_id, {regular_agg()} AS regular_text FROM pages GROUP BY doc_id), "
            f"ocr AS (SELECT k.doc_id, {strip('string_agg(' + ocr_page + ', ' + sql_str('') + ' ORDER BY k.page_no)')} "
            f"AS text FROM kept k LEFT JOIN picked p ON p.doc_id = k.doc_id AND p.page_no = k.page_no GROUP BY k.doc_id), "
            f"extracted AS (SELECT reg.doc_id, CASE WHEN length({strip('regular_text')}) > 50 THEN 'regular' "
            f"ELSE 'ocr' END AS method, CASE WHEN length({strip('regular_text')}) > 50 THEN regular_text "
            f"ELSE coalesce(ocr.text, '') END AS text FROM reg LEFT JOIN ocr USING (doc_id))")


def q_extraction_choice() -> str:
    return f"WITH {cte_extraction()} SELECT doc_id, method, text FROM extracted"


def helpful_sql(subject: str, kind: str, hq: str, q: str) -> str:
    subj = (f"CASE WHEN {subject} <> 'unknown' THEN 'a ' || upper(substring({subject}, 1, 1)) || "
            f"substring({subject}, 2) || ' ' ELSE '' END")
    kind_ = (f"CASE WHEN {kind} = 'homework' THEN {sql_str(R.HELPFUL_TYPE_PHRASES['homework'])} WHEN {kind} = "
             f"'textbook' THEN {sql_str(R.HELPFUL_TYPE_PHRASES['textbook'])} ELSE {sql_str(R.HELPFUL_OTHER_TYPE_PHRASE)} END")
    asked = (f"CASE WHEN {q} IS NOT NULL AND {q} <> '' THEN {sql_str(R.HELPFUL_ASKED_HEAD)} || {q} || "
             f"{sql_str(R.HELPFUL_ASKED_TAIL)} ELSE '' END")
    note = f"CASE WHEN {hq} THEN {sql_str(R.HELPFUL_QUESTIONS_NOTE)} ELSE '' END"
    return (f"{sql_str(R.HELPFUL_HEAD)} || ({subj}) || ({kind_}) || ({asked}) || {sql_str(R.HELPFUL_OFFER)} || "
            f"({note}) || {sql_str(R.HELPFUL_CLOSING)}")


def q_document_intake() -> str:
    ci = content_info("text")
    q = (f"CASE WHEN doc_id % 2 = 0 THEN {pick(S.QUESTION_PHRASES, 'doc_id % 10')} WHEN doc_id % 4 = 1 THEN "
         f"{pick(S.ERROR_PHRASES, f'(doc_id // 4) % {len(S.ERROR_PHRASES)}')} END")
    stored = f"{sql_str(R.SESSION_CONTENT_HEAD)} || {info_repr(ci)} || {NL} || {NL} || text"
    return (f"WITH {cte_extraction()}, x AS (SELECT doc_id, method, text, {blank('text')} AS is_blank, "
            f"{ci['type']} AS type, {ci['subject']} AS subject, {ci['has_questions']} AS hq, {q} AS q, "
            f"sha256({stored}) AS stored_sha FROM extracted) "
            f"SELECT doc_id, method, CASE WHEN NOT is_blank THEN type END AS type, "
            f"CASE WHEN NOT is_blank THEN subject END AS subject, reply, {tool_error('reply')} AS reply_is_error, "
            f"CASE WHEN NOT is_blank THEN stored_sha END AS stored_sha FROM (SELECT *, CASE WHEN is_blank THEN "
            f"{sql_str(R.NO_TEXT_UPLOAD_REPLY)} ELSE {helpful_sql('subject', 'type', 'hq', 'q')} END AS reply FROM x)")


def q_admit_uploads() -> str:
    text = "regexp_replace(html, '\\r\\n?', chr(10), 'g')"
    return (f"WITH {cte_uploads()}, x AS (SELECT page_id, path, {admit('path')} AS kind, {admit('path', True)} AS "
            f"strict_kind, sha256(html) AS sha256, 'utf-8' AS encoding, {text} AS text FROM uploads) "
            f"SELECT page_id, path, kind, strict_kind, sha256, encoding, CAST(length(text) AS INTEGER) AS n_chars, "
            f"CASE WHEN kind = 'unsupported' THEN {sql_str(R.UNSUPPORTED_UPLOAD_REPLY)} WHEN text IS NULL OR "
            f"{strip('text')} = '' THEN {sql_str(R.NO_TEXT_UPLOAD_REPLY)} END AS reply FROM x")


def cte_resolved(source: str = "requests", base: str = "", with_uploads: bool = True) -> str:
    """J1 over ``source`` (needs event_id, subject, chapter, content_source, file)."""
    up_text = strip(f"array_to_string(list_filter(string_split(regexp_replace(html, '\\r\\n?', chr(10), 'g'), {NL}), "
                    f"lambda x: x <> ''), {NL})")
    cat = (f"cat AS (SELECT {pick(S.CATALOG_SUBJECTS, 'doc_id % 6')} AS subject, CAST((doc_id // 6) * 2 + 1 AS INTEGER) "
           f"AS chapter, text FROM documents), cat2 AS (SELECT subject, chapter, 'content/' || subject || '/chapter' || "
           f"CAST(chapter AS VARCHAR) || '.pdf' AS path, text FROM cat)")
    j = (f"j AS (SELECT r.*, {route_source('r.content_source')} AS route, "
         f"{coerce('r.file')} AS fp, lower(r.subject) AS cs, {chapter_int('r.chapter')} AS cc, "
         f"c.path AS chapter_path, c.text AS chapter_text, u.text AS upload_text, u.path IS NOT NULL AS up_exists "
         f"FROM {source} r LEFT JOIN cat2 c ON c.subject = lower(r.subject) AND c.chapter = {chapter_int('r.chapter')} "
         f"LEFT JOIN up u ON u.path = {coerce('r.file')})")
    no_file = "(fp IS NULL OR fp = '')"
    status = (f"CASE WHEN route = 'camera' THEN 'camera' WHEN route = 'upload' AND ({no_file} OR NOT up_exists) "
              f"THEN 'missing' WHEN route = 'upload' THEN CASE WHEN lower({suffix('fp')}) <> '.pdf' THEN 'unsupported' "
              f"WHEN coalesce(upload_text, '') = '' THEN 'unreadable' ELSE 'ok' END "
              f"WHEN chapter_path IS NULL THEN 'missing' WHEN coalesce(chapter_text, '') = '' THEN 'unreadable' "
              f"ELSE 'ok' END")
    content = ("CASE WHEN status = 'ok' AND route = 'upload' THEN upload_text WHEN status = 'ok' AND route = 'chapter' "
               "THEN chapter_text ELSE '' END")
    detail = (f"CASE WHEN route = 'upload' AND {no_file} THEN {sql_str(R.NO_PDF_UPLOADED)} "
              f"WHEN route = 'upload' AND NOT up_exists THEN {sql_str(R.UPLOAD_NOT_FOUND_HEAD)} || fp "
              f"WHEN route = 'upload' AND status = 'unsupported' THEN {sql_str(R.UNSUPPORTED_HEAD)} || {suffix('fp')} "
              f"|| {sql_str(R.UNSUPPORTED_TAIL)} WHEN route = 'upload' AND status = 'unreadable' THEN "
              f"{sql_str(R.UPLOAD_NO_TEXT)} WHEN route = 'chapter' AND status = 'missing' THEN "
              f"{sql_str(R.CHAPTER_NOT_FOUND_HEAD)} || 'content/' || cs || '/chapter' || CAST(cc AS VARCHAR) || '.pdf' "
              f"|| ' (subject=' || coalesce(subject, 'None') || ', chapter=' || CAST(cc AS VARCHAR) || ')' "
              f"WHEN route = 'chapter' AND status = 'unreadable' THEN {sql_str(R.CHAPTER_NO_TEXT_HEAD)} || chapter_path "
              f"|| {sql_str(R.CHAPTER_NO_TEXT_TAIL)} END")
    msg = (f"CASE WHEN status = 'missing' THEN {sql_str(R.NOT_FOUND_HEAD)} || detail WHEN status IN "
           f"('unreadable', 'unsupported') THEN {sql_str(R.UNREADABLE_HEAD)} || detail END")
    uploads = cte_uploads() + ", " if with_uploads else ""
    return (f"{base}{uploads}up AS (SELECT path, {up_text} AS text FROM uploads), {cat}, {j}, "
            f"s AS (SELECT *, {status} AS status FROM j), t AS (SELECT *, {content} AS content, {detail} AS detail FROM s), "
            f"resolved AS (SELECT *, {msg} AS status_message FROM t)")


def q_resolve_content() -> str:
    return (f"WITH {cte_resolved(base=cte_requests() + ', ')} "
            f"SELECT event_id, route, status, sha256(content) AS content_sha, status_message FROM resolved")



def info_repr(ci: dict) -> str:
    b = lambda e: f"CASE WHEN {e} THEN 'True' ELSE 'False' END"
    return (f"'{{''type'': ''' || {ci['type']} || ''', ''subject'': ''' || {ci['subject']} || ''', "
            f"''has_questions'': ' || {b(ci['has_questions'])} || ', ''has_exercises'': ' || {b(ci['has_exercises'])} "
            f"|| ', ''confidence'': ' || CAST({ci['confidence']} AS VARCHAR) || '}}'")


def split_sql(s: str) -> str:
    return (f"(CASE WHEN contains({s}, {sql_str(R.SESSION_CONTENT_MARKER)}) AND strpos({s}, {NL} || {NL}) > 0 THEN "
            f"substring({s}, strpos({s}, {NL} || {NL}) + 2) ELSE {s} END)")


def q_session_content() -> str:
    ci = content_info("text")
    stored = f"{sql_str(R.SESSION_CONTENT_HEAD)} || {info_repr(ci)} || {NL} || {NL} || coalesce(text, '')"
    return (f"WITH {cte_content_documents()}, x AS (SELECT doc_id, text, {stored} AS stored FROM content_documents) "
            f"SELECT doc_id, sha256(stored) AS stored_sha, {split_sql('stored')} = text AS round_trip, "
            f"sha256({split_sql('text')}) AS raw_split_sha FROM x")


def q_helpful_responses() -> str:
    ci = content_info("text")
    q = f"CASE WHEN doc_id % 2 = 0 THEN {pick(S.QUESTION_PHRASES, 'doc_id % 10')} END"
    subj = "CASE WHEN subject <> 'unknown' THEN 'a ' || upper(substring(subject, 1, 1)) || substring(subject, 2) || ' ' ELSE '' END"
    kind = (f"CASE WHEN type = 'homework' THEN {sql_str(R.HELPFUL_TYPE_PHRASES['homework'])} WHEN type = 'textbook' "
            f"THEN {sql_str(R.HELPFUL_TYPE_PHRASES['textbook'])} ELSE {sql_str(R.HELPFUL_OTHER_TYPE_PHRASE)} END")
    asked = (f"CASE WHEN q IS NOT NULL AND q <> '' THEN {sql_str(R.HELPFUL_ASKED_HEAD)} || q || "
             f"{sql_str(R.HELPFUL_ASKED_TAIL)} ELSE '' END")
    note = f"CASE WHEN hq THEN {sql_str(R.HELPFUL_QUESTIONS_NOTE)} ELSE '' END"
    return (f"WITH {cte_content_documents()}, x AS (SELECT doc_id, {ci['subject']} AS subject, {ci['type']} AS type, "
            f"{ci['has_questions']} AS hq, {q} AS q FROM content_documents) SELECT doc_id, "
            f"{sql_str(R.HELPFUL_HEAD)} || ({subj}) || ({kind}) || ({asked}) || {sql_str(R.HELPFUL_OFFER)} || ({note}) || "
            f"{sql_str(R.HELPFUL_CLOSING)} AS reply FROM x")


def q_tool_replies() -> str:
    return (f"WITH {cte_requests()}, x AS (SELECT event_id, subject, CASE WHEN event_id % 2 = 0 THEN 'unknown_question' "
            f"ELSE 'user_details' END AS kind FROM requests) SELECT event_id, kind, CASE WHEN kind = 'unknown_question' "
            f"THEN {sql_str(R.UNKNOWN_QUESTION_REPLY_HEAD)} || coalesce(subject, 'None') || "
            f"{sql_str(R.UNKNOWN_QUESTION_REPLY_TAIL)} WHEN kind = 'user_details' THEN {sql_str(R.USER_DETAILS_REPLY)} "
            f"END AS reply FROM x")


def task_sql() -> str:
    return (f"CASE WHEN content_source = {CAM} THEN 'document_analysis_task' WHEN intent = 'greeting' THEN "
            f"'teaching_task' WHEN intent = 'smart_first_response' THEN 'smart_response_task' ELSE 'follow_up_task' END")


def render_sql(values: dict, task: str = "task") -> str:
    def render(template):
        parts = []
        for p in template_parts(template):
            if isinstance(p, tuple):
                parts.append(f"coalesce({values[p[1]]}, '')")
            elif p:
                parts.append(sql_str(p))
        return " || ".join(parts)
    return "CASE " + " ".join(f"WHEN {task} = {sql_str(n)} THEN {render(t)}" for n, t in TASK_TEMPLATES.items()) + " END"


def cte_texts(source: str) -> str:
    """J1 over ``source`` and the text of the stored document (J3); needs the CTEs of ``cte_routed``."""
    return (f"{cte_current_document(base=False)}, {cte_resolved(source=source, with_uploads=False)}, "
            "texts AS (SELECT resolved.*, cd.doc_path, doc.text AS document_text, own.path IS NOT NULL AS file_exists "
            "FROM resolved JOIN cd USING (event_id) LEFT JOIN up doc ON doc.path = cd.doc_path "
            "LEFT JOIN up own ON own.path = resolved.file_path)")


def q_prompts() -> str:
    values = {"subject": "subject", "chapter_number": "CAST(chapter_no AS VARCHAR)", "chapter_content": "content",
              "student_query": "cache_query", "student_question": "message", "document_text": "document_text"}
    return (f"WITH {cte_routed()}, {cte_texts('routed')}, x AS (SELECT *, {task_sql()} AS task FROM texts), y AS (SELECT event_id, task, "
            f"{render_sql(values)} AS p FROM x) SELECT event_id, task, sha256(p) AS prompt_sha, "
            f"CAST(length(p) AS INTEGER) AS prompt_chars FROM y")


def q_answer_worklist() -> str:
    missing = "(file_path IS NULL OR file_path = '')"
    prompt = (f"CASE WHEN content_source = {CAM} AND {missing} AND intent = 'greeting' THEN "
              f"{sql_str(R.CAMERA_PROMPT_GREETING)} WHEN content_source = {CAM} AND {missing} THEN "
              f"{sql_str(R.CAMERA_PROMPT_QUESTION)} WHEN content_source = {sql_str(R.SOURCE_UPLOAD)} AND {missing} "
              f"THEN {sql_str(R.NOT_FOUND_HEAD + R.NO_PDF_UPLOADED)} END")
    values = {"subject": "subject", "chapter_number": "CAST(chapter_no AS VARCHAR)", "chapter_content": "content",
              "student_query": "cache_query", "student_question": "message", "document_text": "document_text"}
    refused = (f"CASE WHEN content_source = {CAM} AND file_path <> '' AND {admit('file_path')} = 'unsupported' THEN "
               f"{sql_str(R.UNSUPPORTED_UPLOAD_REPLY)} END")
    unread = (f"CASE WHEN content_source = {CAM} AND file_path <> '' AND doc_path IS NULL THEN CASE WHEN file_exists THEN "
              f"{sql_str(R.NO_TEXT_UPLOAD_REPLY)} ELSE {sql_str(R.UPLOAD_ERROR_REPLY)} END END")
    early = (f"early_idx AS (SELECT key, text, CASE WHEN version % 3 = 0 THEN 'audio/' || key || '.mp3' END AS audio "
             f"FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version "
             f"DESC) AS rn FROM entries WHERE conv_turn < {S.INDEX_CUTOFF_TURN}) WHERE rn = 1)")
    looked = ("looked AS (SELECT r.*, e.key IS NOT NULL AS hit, e.text AS cached_text, e.audio AS cached_audio FROM routed r "
              "LEFT JOIN early_idx e ON r.key = e.key)")
    w = (f"w AS (SELECT *, coalesce({prompt}, {refused}, {unread}, status_message) AS reply0, {task_sql()} AS task0 FROM texts), "
         f"w2 AS (SELECT *, CASE WHEN hit AND coalesce(cached_text <> '', false) AND coalesce(cached_audio, '') = '' THEN 'synthesize_audio' "
         f"WHEN hit THEN 'serve' WHEN reply0 IS NOT NULL THEN 'reply_status' ELSE 'generate' END AS action FROM w)")
    return (f"WITH {cte_routed()}, {early}, {looked}, "
            f"{cte_texts('looked')}, {w} "
            f"SELECT event_id, hit, action, status, CASE WHEN action = 'reply_status' THEN reply0 END AS reply, "
            f"CASE WHEN action = 'generate' THEN task0 END AS task, CASE WHEN action = 'generate' THEN "
            f"sha256({render_sql(values, 'task0')}) END AS prompt_sha FROM w2")


ORACLES = {
    "document_profile": q_document_profile(),
    "content_type": q_content_type(),
    "content_type_legacy": q_content_type(legacy=True),
    "detect_language": q_detect_language(),
    "question_rules": q_question_rules(),
    "number_turns": q_number_turns(),
    "route_requests": q_route_requests(),
    "cache_replay": q_cache_replay(),
    "cache_lookup": q_cache_lookup(),
    "upsert_responses": q_upsert_responses(),
    "store_answers": q_store_answers(),
    "audio_plan": q_audio_plan(),
    "clean_answers": q_clean_answers(),
    "speech_text": q_speech_text(),
    "pair_turns": q_pair_turns(),
    "render_transcript": q_render_transcript(),
    "transcript_lines": q_transcript_lines(),
    "replay_turn": q_replay_turn(),
    "quick_actions": q_quick_actions(),
    "current_document": q_current_document(),
    "document_answers": q_document_answers(),
    "upgrade_history": q_upgrade_history(),
    "assemble_pages": q_assemble_pages(),
    "pick_ocr_text": q_pick_ocr_text(),
    "truncate_at_failure": q_truncate_at_failure(),
    "extraction_choice": q_extraction_choice(),
    "admit_uploads": q_admit_uploads(),
    "resolve_content": q_resolve_content(),
    "session_content": q_session_content(),
    "helpful_responses": q_helpful_responses(),
    "tool_replies": q_tool_replies(),
    "prompts": q_prompts(),
    "answer_worklist": q_answer_worklist(),
    "document_intake": q_document_intake(),
}

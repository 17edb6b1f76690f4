"""SQL twins of the queries, for an engine that shares no code with them.

Training is unrolled one merge at a time over nested string replacement; everything that
needs an encoding joins the pieces of a text to the fully merged words.
"""

from __future__ import annotations

from glyphmill.fixed import ADDITIONAL_SPECIAL_TOKENS, DEFAULT_SYSTEM, SPECIAL_TOKENS, TOOLS_INTRO, TOOLS_OUTRO
from glyphmill.plans.queries import (
    ACTIONS,
    CHAR_MERGES,
    EXPANSION,
    MAX_LENGTH,
    MERGES,
    OTHER_MERGES,
    RETRAINED_MERGES,
    TRAINED_MERGES,
)

PIECES = (
    r"(?:(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+|[\p{L}\p{N}]+)"
)
DIGITS = r"\p{N}|[^\p{N}]+"
N_SPECIAL = len(SPECIAL_TOKENS)


def quoted(text: str) -> str:
    """A SQL literal; line feeds go in as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def pieces_of(text: str, pattern: str = PIECES) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


HEX_BYTES = "regexp_extract_all(hex(encode({0})), '..')"


def visible(h: str) -> str:
    """Code point of the visible character for a byte given in hex."""
    b = f"('0x' || {h})::INTEGER"
    return (
        f"(CASE WHEN {b} < 33 THEN 256 + {b} WHEN {b} BETWEEN 127 AND 160 THEN 289 + {b} - 127 "
        f"WHEN {b} = 173 THEN 323 ELSE {b} END)"
    )


def visible_text(hexed: str) -> str:
    listed = f"regexp_extract_all({hexed}, '..')"
    return f"array_to_string(list_transform({listed}, lambda h: chr({visible('h')})), '')"


def training(source: str, merges: int, p: str = "", text: str = "text") -> str:
    """CTEs: {p}pc pieces, {p}al alphabet, {p}m all merges, {p}v vocabulary, {p}w merged words."""
    out = [
        f"{p}pc AS MATERIALIZED (SELECT piece, count(*) AS c FROM "
        f"(SELECT unnest({pieces_of(text)}) AS piece FROM {source}) GROUP BY piece)",
        f"{p}w0 AS MATERIALIZED (SELECT piece, c, regexp_replace(hex(encode(piece)), '(..)', ' \\1 ', 'g') AS s FROM {p}pc)",
        f"{p}al AS MATERIALIZED (SELECT tok, {N_SPECIAL} - 1 + row_number() OVER (ORDER BY {visible('tok')}) AS id "
        f"FROM (SELECT DISTINCT unnest({HEX_BYTES.format('piece')}) AS tok FROM {p}pc))",
        f"{p}v0 AS MATERIALIZED (SELECT tok, id FROM {p}al)",
    ]
    for k in range(merges):
        out.append(
            f"{p}m{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, l || r AS tok, n FROM (SELECT z[1] AS l, z[2] AS r, "
            f"sum(c) AS n FROM (SELECT c, unnest(list_zip(a[:-2], a[2:])) AS z FROM "
            f"(SELECT c, string_split(trim(s), '  ') AS a FROM {p}w{k}) WHERE len(a) > 1) GROUP BY 1, 2) q "
            f"JOIN {p}v{k} x ON x.tok = q.l JOIN {p}v{k} y ON y.tok = q.r ORDER BY n DESC, x.id, y.id LIMIT 1)"
        )
        out.append(
            f"{p}w{k + 1} AS MATERIALIZED (SELECT piece, c, replace(s, ' ' || l || '  ' || r || ' ', "
            f"' ' || l || r || ' ') AS s FROM {p}w{k}, {p}m{k})"
        )
        out.append(
            f"{p}v{k + 1} AS MATERIALIZED (SELECT tok, id FROM {p}v{k} UNION ALL SELECT tok, "
            f"(SELECT max(id) + 1 FROM {p}v{k}) FROM {p}m{k} WHERE tok NOT IN (SELECT tok FROM {p}v{k}))"
        )
    union = " UNION ALL ".join(f"SELECT rank, l, r, tok, n FROM {p}m{k}" for k in range(merges))
    out.append(f"{p}m AS MATERIALIZED ({union})")
    out.append(f"{p}v AS MATERIALIZED (SELECT tok, id FROM {p}v{merges})")
    out.append(f"{p}w AS MATERIALIZED (SELECT piece, string_split(trim(s), '  ') AS toks FROM {p}w{merges})")
    return ", ".join(out)


def known_symbols(piece: str) -> str:
    """A piece as spaced hex bytes without those outside the list ``known``: they vanish before any merge."""
    kept = f"list_filter({HEX_BYTES.format(piece)}, lambda h: list_contains(known, h))"
    return f"array_to_string(list_transform({kept}, lambda h: ' ' || h || ' '), '')"


def encoding(p: str = "") -> str:
    """CTE {p}e: per distinct piece its tokens in hex and their ids, as lists."""
    return (
        f"{p}e AS MATERIALIZED (SELECT piece, list(id ORDER BY pos) AS ids, list(t ORDER BY pos) AS toks FROM "
        f"(SELECT piece, unnest(toks) AS t, unnest(range(1, len(toks) + 1)) AS pos FROM {p}w) JOIN {p}v ON tok = t GROUP BY piece)"
    )


def encoded(source: str, key: str, p: str = "", text: str = "text", name: str = "x") -> str:
    """CTE {name}: key with ids and toks of a text, as flat lists."""
    return (
        f"{name} AS MATERIALIZED (SELECT {key}, flatten(list(ids ORDER BY pos)) AS ids, flatten(list(toks ORDER BY pos)) AS toks FROM "
        f"(SELECT {key}, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS pos FROM "
        f"(SELECT {key}, {pieces_of(text)} AS a FROM {source})) JOIN {p}e USING (piece) GROUP BY {key})"
    )


DOCS = f"WITH {training('documents', MERGES)}"
CODED = f"{DOCS}, {encoding()}, {encoded('documents', 'doc_id')}"
OTHER = training("benchmark", OTHER_MERGES, "b_")


def text_of(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def padded(n: int) -> str:
    return f"list_concat(ids[:{n}], list_transform(range(greatest({n} - len(ids), 0)), lambda z: 0::BIGINT))"


def mask(n: int) -> str:
    return (
        f"list_concat(list_transform(range(least(len(ids), {n})), lambda z: 1), "
        f"list_transform(range(greatest({n} - len(ids), 0)), lambda z: 0))"
    )


TRAINING_ROWS = (
    f"SELECT doc_id, {text_of(padded(MAX_LENGTH))} AS input_ids, {text_of(mask(MAX_LENGTH))} AS attention_mask, "
    f"{text_of(f'list_transform(range({MAX_LENGTH}), lambda z: 0)')} AS token_type_ids FROM x"
)

LINES = "SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM {0}) GROUP BY text"
STRIPPED = (
    "SELECT text, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS text "
    "FROM documents) GROUP BY text"
)

VOCAB_OUT = (
    "SELECT id::INTEGER AS token_id, token_hex, kind FROM ("
    "SELECT id, tok AS token_hex, CASE WHEN id < (SELECT count(*) FROM al) + {n} THEN 'byte' ELSE 'merge' END AS kind FROM v "
    "UNION ALL SELECT i, hex(encode(s)), 'special' FROM (VALUES {sp}) t(i, s))"
).format(n=N_SPECIAL, sp=values(list(enumerate(SPECIAL_TOKENS))))


def appended(rows: str) -> str:
    """The vocabulary followed by the rows (seen_at, token_hex) it lacks."""
    return (
        f"SELECT token_id, token_hex, kind FROM ({VOCAB_OUT}) UNION ALL SELECT (row_number() OVER (ORDER BY s) - 1 + "
        f"(SELECT max(token_id) + 1 FROM ({VOCAB_OUT})))::INTEGER, token_hex, 'appended' FROM (SELECT token_hex, min(seen_at) AS s "
        f"FROM ({rows}) WHERE token_hex NOT IN (SELECT token_hex FROM ({VOCAB_OUT})) GROUP BY token_hex)"
    )


# --- conversations -----------------------------------------------------------------------

S, E = "'<|im_start|>'", "'<|im_end|>' || chr(10)"
NL = "chr(10)"


def lstrip(x: str) -> str:
    return f"ltrim({x}, chr(10))"


def rstrip(x: str) -> str:
    return f"rtrim({x}, chr(10))"


def reasoning(x: str) -> str:
    head = rstrip(f"string_split({x}, '</think>')[1]")
    return f"(CASE WHEN contains({x}, '</think>') THEN {lstrip(f'string_split({head}, {quoted("<think>")})[-1]')} ELSE '' END)"


def answer(x: str) -> str:
    last = f"string_split({x}, '</think>')[-1]"
    return f"(CASE WHEN contains({x}, '</think>') THEN {lstrip(last)} ELSE {x} END)"


def chat_ctes(source: str, closing: str = "''") -> str:
    """CTE ch(conv_id, prompt). ``source`` has conv_id, turn, role, content, calls, tools."""
    calls = (
        "array_to_string(list_transform(coalesce(calls, []), lambda c, i: (CASE WHEN i > 1 OR a <> '' THEN chr(10) ELSE '' END) || "
        "'<tool_call>' || chr(10) || c || chr(10) || '</tool_call>'), '')"
    )
    header = (
        f"{S} || 'system' || {NL} || (CASE WHEN role = 'system' THEN content || {NL} || {NL} ELSE '' END) || {quoted(TOOLS_INTRO)} || "
        f"array_to_string(list_transform(tools, lambda t: chr(10) || t), '') || {quoted(TOOLS_OUTRO)} || {E}"
    )
    return f"""
      src AS (SELECT * FROM {source}),
      lq AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'user' AND NOT (starts_with(content, '<tool_response>')
             AND ends_with(content, '</tool_response>'))), max(turn)) AS q, min(turn) AS f, max(turn) AS z FROM src GROUP BY conv_id),
      tn AS (SELECT src.*, q, f, z, lag(role) OVER w AS pr, lead(role) OVER w AS nx, {reasoning('content')} AS rs, {answer('content')} AS a
             FROM src JOIN lq USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      pt AS (SELECT conv_id, turn, (CASE WHEN turn = f AND len(coalesce(tools, [])) > 0 THEN {header}
               WHEN turn = f AND role = 'system' THEN {S} || 'system' || {NL} || content || {E} ELSE '' END)
             || (CASE WHEN role = 'user' OR (role = 'system' AND turn <> f) THEN {S} || role || {NL} || content || {E}
               WHEN role = 'assistant' THEN {S} || 'assistant' || {NL} || (CASE WHEN turn > q AND (turn = z OR rs <> '')
                 THEN '<think>' || {NL} || {lstrip(rstrip('rs'))} || {NL} || '</think>' || {NL} || {NL} || {lstrip('a')} ELSE a END)
                 || {calls} || {E}
               WHEN role = 'tool' THEN (CASE WHEN pr = 'tool' THEN '' ELSE {S} || 'user' END) || {NL} || '<tool_response>' || {NL}
                 || content || {NL} || '</tool_response>' || (CASE WHEN nx = 'tool' THEN '' ELSE {E} END)
               ELSE '' END)
             || (CASE WHEN turn = z THEN {closing} ELSE '' END) AS part FROM tn),
      ch AS MATERIALIZED (SELECT conv_id, string_agg(part, '' ORDER BY turn) AS prompt FROM pt GROUP BY conv_id)"""


PLAIN = "(SELECT conv_id, turn, role, text AS content, NULL::VARCHAR[] AS calls, NULL::VARCHAR[] AS tools FROM conversations)"
TAGGED = f"'<think>' || {NL} || text || {NL} || {NL} || '</think>' || {NL} || {NL} || text"
THINKING = (
    f"(SELECT conv_id, turn, role, CASE (turn + conv_id) % 4 WHEN 0 THEN {TAGGED} WHEN 1 THEN {TAGGED} || {TAGGED} "
    "WHEN 2 THEN text || '</think>' || text ELSE text END AS content FROM conversations)"
)
CALL_ONE = """'{"name": "search", "arguments": {"turn": ' || turn || '}}'"""
CALL_TWO = """'{"name": "fetch", "arguments": {}}'"""
TOOLED = (
    "(SELECT conv_id, turn, CASE WHEN role = 'user' AND (turn + conv_id) % 5 IN (0, 1) AND turn > 1 THEN 'tool' ELSE role END AS role, "
    f"content, CASE WHEN role = 'assistant' AND (turn + conv_id) % 5 = 2 THEN [{CALL_ONE}, {CALL_TWO}] "
    f"WHEN role = 'assistant' AND (turn + conv_id) % 5 = 3 THEN [{CALL_ONE}] END AS calls, "
    "CASE WHEN conv_id % 2 = 0 THEN ['{\"name\": \"search\"}', '{\"name\": \"fetch\"}'] END AS tools FROM "
    f"{THINKING})"
)
ASK = f"{S} || 'assistant' || {NL}"
NO_THINK = f"{ASK} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL}"


def marked(x: str) -> str:
    """Special tokens set apart by chr(1), longest first."""
    any_of = "|".join(s.replace("|", r"\|") for s in sorted(SPECIAL_TOKENS, key=lambda s: (-len(s), s)))
    return f"list_filter(string_split(regexp_replace({x}, {quoted(f'({any_of})')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def chat_encoded() -> str:
    """CTE cx(conv_id, ids): prompts of ch through the document vocabulary, specials whole.

    A piece the training corpus lacks is merged here, one merge after the other.
    """
    merged = known_symbols("piece")
    for k in range(MERGES):
        pair = f"(SELECT ' ' || l || '  ' || r || ' ' FROM m{k})"
        whole = f"(SELECT ' ' || tok || ' ' FROM m{k})"
        merged = f"replace({merged}, {pair}, {whole})"
    return f"""
      sp AS (SELECT * FROM (VALUES {values(list(enumerate(SPECIAL_TOKENS)))}) t(id, content)),
      sg AS MATERIALIZED (SELECT conv_id, unnest(g) AS seg, unnest(range(1, len(g) + 1)) AS gi FROM (SELECT conv_id, {marked('prompt')} AS g FROM ch)),
      sq AS MATERIALIZED (SELECT conv_id, gi, piece, pi, sp.id AS sid FROM (
             SELECT sg.conv_id, gi, seg, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS pi FROM (
               SELECT *, CASE WHEN seg IN (SELECT content FROM sp) THEN [seg] ELSE {pieces_of('seg')} END AS a FROM sg) sg) z
             LEFT JOIN sp ON sp.content = z.piece AND sp.content = z.seg),
      sw AS MATERIALIZED (SELECT piece, string_split(trim({merged}), '  ') AS toks FROM (SELECT DISTINCT piece FROM sq WHERE sid IS NULL), (SELECT list(tok) AS known FROM al)),
      se AS MATERIALIZED (SELECT piece, list(id ORDER BY pos) AS ids FROM (SELECT piece, unnest(toks) AS t, unnest(range(1, len(toks) + 1)) AS pos FROM sw)
             JOIN v ON tok = t GROUP BY piece),
      cx AS MATERIALIZED (SELECT conv_id, flatten(list(CASE WHEN sid IS NULL THEN coalesce(se.ids, []) ELSE [sid::BIGINT] END ORDER BY gi, pi)) AS ids
             FROM sq LEFT JOIN se USING (piece) GROUP BY conv_id)"""


def decoded(ids: str) -> str:
    """CTE-free text of a list column of ids through v, specials skipped, newlines stripped."""
    return (
        f"trim(coalesce((SELECT decode(unhex(string_agg(tok, '' ORDER BY o))) FROM (SELECT unnest({ids}) AS i, "
        f"unnest(range(1, len({ids}) + 1)) AS o) JOIN v ON v.id = i), ''), chr(10))"
    )


# --- character training ------------------------------------------------------------------

# fixed values: script names of the SQL engine's regular expressions
SCRIPT_NAMES = (
    "Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid "
    "Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Coptic Cuneiform Cypriot Cyrillic Deseret Devanagari Dives_Akuru Dogra "
    "Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Georgian Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi Hangul Hanifi_Rohingya "
    "Hanunoo Hatran Hebrew Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kannada Kayah_Li Kharoshthi Khitan_Small_Script "
    "Khmer Khojki Khudawadi Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen Masaram_Gondi "
    "Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nandinagari New_Tai_Lue "
    "Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian "
    "Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian "
    "Siddham SignWriting Sinhala Sogdian Sora_Sompeng Soyombo Sundanese Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut "
    "Telugu Thaana Thai Tibetan Tifinagh Tirhuta Ugaritic Vai Wancho Warang_Citi Yezidi Yi Zanabazar_Square"
).split()


def words_pattern() -> str:
    digit = r"0-9\x{ff10}-\x{ff19}"
    scripts = [rf"\p{{{s}}}" for s in SCRIPT_NAMES] + [r"\p{Han}\p{Hiragana}\p{Katakana}\x{30fc}"]
    runs = [rf"[{s}][{s}\p{{Inherited}}]*" for s in scripts]
    runs.append(rf"[^{''.join(scripts)}{digit}▁]+")
    return rf"[{digit}]|▁?(?:{'|'.join(runs)})|▁"


def char_training(merges: int) -> str:
    """CTEs g* for character merges: ties to the shorter, then smaller, piece."""
    sep = "chr(1)"
    out = [
        f"gp AS MATERIALIZED (SELECT piece, count(*) AS c FROM (SELECT unnest({pieces_of('replace(line, chr(32), ' + quoted('▁') + ')', words_pattern())}) AS piece "
        "FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY piece)",
        f"gw0 AS MATERIALIZED (SELECT c, regexp_replace(piece, '((?s).)', {sep} || '\\1' || {sep}, 'g') AS s FROM gp)",
    ]
    for k in range(merges):
        out.append(
            f"gm{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, l || r AS tok, sum(c) AS n FROM (SELECT c, z[1] AS l, z[2] AS r FROM "
            f"(SELECT c, unnest(list_zip(a[:-2], a[2:])) AS z FROM (SELECT c, string_split(trim(s, {sep}), {sep} || {sep}) AS a FROM gw{k}) "
            f"WHERE len(a) > 1)) WHERE length(l || r) <= 32 GROUP BY l, r ORDER BY n DESC, length(l || r), l || r LIMIT 1)"
        )
        out.append(
            f"gw{k + 1} AS MATERIALIZED (SELECT c, replace(s, {sep} || l || {sep} || {sep} || r || {sep}, {sep} || l || r || {sep}) AS s FROM gw{k}, gm{k})"
        )
    union = " UNION ALL ".join(f"SELECT rank, tok FROM gm{k}" for k in range(merges))
    out.append(f"gm AS MATERIALIZED ({union})")
    out.append(
        "gc AS MATERIALIZED (SELECT ch, row_number() OVER (ORDER BY n DESC, ch) - 1 AS i FROM (SELECT ch, sum(c) AS n FROM "
        "(SELECT c, unnest(regexp_extract_all(piece, '(?s).')) AS ch FROM gp) GROUP BY ch))"
    )
    return ", ".join(out)


CHAR_FIXED = [(0, "<unk>", 0.0)] + [(1 + i, s, 0.0) for i, s in enumerate(SPECIAL_TOKENS[:3])]
CHAR_FIRST = len(CHAR_FIXED)


def six(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 6) AS {name}"


def quantiles(column: str) -> str:
    return ", ".join(six(f"quantile_cont({column}, {q})", f"p{round(q * 100)}") for q in (0.5, 0.75, 0.9, 0.95, 0.99))


def routing_ctes(weight: str) -> str:
    """CTEs for router reports: pb(vec_id, w, expert, p) and tk(vec_id, w, slot, expert, p)."""
    return f"""
      lg AS (SELECT vec_id, {weight} AS w, list_transform(embedding, lambda x: x::DOUBLE * 10) AS l FROM embeddings),
      ex AS (SELECT vec_id, w, unnest(l) AS x, unnest(range(len(l))) AS expert, list_max(l) AS m FROM lg),
      pb AS MATERIALIZED (SELECT vec_id, w, expert, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS p FROM ex),
      tk AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) - 1 AS slot FROM pb) WHERE slot < 4)"""


def load_sql(weight: str) -> str:
    return f"""WITH {routing_ctes(weight)},
      gr AS (SELECT s.slot, e.expert FROM (SELECT unnest(range(4)) AS slot) s, (SELECT DISTINCT expert FROM pb) e),
      sh AS (SELECT slot, expert, sum(w) AS f FROM tk GROUP BY slot, expert),
      pr AS (SELECT expert, sum(p * w) / sum(w) AS probability, sum(w) AS t FROM pb GROUP BY expert),
      ft AS (SELECT slot, expert, coalesce(f, 0) / t AS share, probability FROM gr LEFT JOIN sh USING (slot, expert) JOIN pr USING (expert))
      SELECT slot::INTEGER AS slot, expert::INTEGER AS expert, {six('share', 'share')}, {six('probability', 'probability')},
      {six('(SELECT count(DISTINCT expert) * sum(share * probability) FROM ft)', 'imbalance')} FROM ft"""


ROLES = [("eos_token", "<|im_end|>", 2), ("pad_token", "<|endoftext|>", 0)]
ROLES += [("additional_special_tokens", s, SPECIAL_TOKENS.index(s)) for s in ADDITIONAL_SPECIAL_TOKENS]

ORDERED = (
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:1:' || doc_id), doc_id) - 1 AS shuffle_rank FROM documents"
)
SAMPLE = (
    "SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('{0}:' || doc_id), doc_id) <= {1}"
)

ORACLES = {
    "s1_read_jsonl": "SELECT doc_id, text FROM documents",
    "s2_read_parquet": "SELECT doc_id, text FROM documents",
    "s3_read_text": STRIPPED,
    "s4_read_json_array": "SELECT text, count(*) AS n FROM documents GROUP BY text",
    "s5_read_csv": "SELECT doc_id, lang, text FROM documents",
    "s6_read_corpus": (
        "SELECT format, text, count(*) AS n FROM (SELECT 'parquet' AS format, text FROM documents UNION ALL "
        "SELECT 'text', unnest(string_split(text, chr(10))) FROM documents UNION ALL SELECT 'csv', text FROM benchmark UNION ALL "
        "SELECT 'jsonl', text FROM conversations UNION ALL SELECT 'json', text FROM benchmark) GROUP BY format, text"
    ),
    "s7_require_text": "SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents",
    "s8_write_jsonl": (
        "SELECT source AS shard, '{\"doc_id\":' || d.doc_id || ',\"quality\":' || coalesce(quality::VARCHAR, 'null') || ',\"source\":\"' || source || '\",\"text\":' || to_json(text) || '}' AS line "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    ),
    "s9_write_lines": LINES.format("conversations"),
    "s10_tokens": f"{CODED} {TRAINING_ROWS}",
    "s11_save_load_vocab": f"{DOCS} {VOCAB_OUT}",
    "s12_stream_corpus": LINES.format("documents"),
    "n1_normalize_nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "n2_normalize_nfkc_strip": "SELECT doc_id, text FROM documents",
    "n3_normalize_decompose_strip": "SELECT doc_id, strip_accents(text) AS text FROM documents",
    "p1_split_pieces": f"SELECT doc_id, len(a)::BIGINT AS n, array_to_string(a, chr(31)) AS items FROM (SELECT doc_id, {pieces_of('text')} AS a FROM documents)",
    "p2_byte_symbols": (
        f"SELECT piece, len(a)::BIGINT AS n, array_to_string(list_transform(a, lambda h: chr({visible('h')})), chr(31)) AS items FROM "
        f"(SELECT piece, {HEX_BYTES.format('piece')} AS a FROM (SELECT DISTINCT unnest({pieces_of('text')}) AS piece FROM documents))"
    ),
    "p3_split_digits": f"SELECT doc_id, len(a)::BIGINT AS n, array_to_string(a, chr(31)) AS items FROM (SELECT doc_id, {pieces_of('text', DIGITS)} AS a FROM documents)",
    "p4_split_special": (
        f"WITH {chat_ctes(PLAIN, ASK)} SELECT conv_id, len(a)::BIGINT AS n, array_to_string(a, chr(31)) AS items FROM "
        f"(SELECT conv_id, {marked('prompt')} AS a FROM ch)"
    ),
    "p5_piece_counts": f"SELECT piece, count(*) AS n FROM (SELECT unnest({pieces_of('text')}) AS piece FROM documents) GROUP BY piece",
    "p6_char_alphabet": (
        f"SELECT chr({visible('h')}) AS symbol, count(*) AS n, row_number() OVER (ORDER BY {visible('h')}) - 1 AS position FROM "
        f"(SELECT unnest({HEX_BYTES.format('text')}) AS h FROM documents) GROUP BY h"
    ),
    "t1_pair_counts": (
        f"SELECT z[1] AS l, z[2] AS r, count(*) AS n FROM (SELECT unnest(list_zip(a[:-2], a[2:])) AS z FROM (SELECT {HEX_BYTES.format('piece')} AS a FROM "
        f"(SELECT unnest({pieces_of('text')}) AS piece FROM documents)) WHERE len(a) > 1) GROUP BY 1, 2"
    ),
    "t2_top_pairs": (
        f"SELECT l, r, n FROM (SELECT z[1] AS l, z[2] AS r, count(*) AS n FROM (SELECT unnest(list_zip(a[:-2], a[2:])) AS z FROM (SELECT {HEX_BYTES.format('piece')} AS a FROM "
        f"(SELECT unnest({pieces_of('text')}) AS piece FROM documents)) WHERE len(a) > 1) GROUP BY 1, 2) ORDER BY n DESC, {visible('l')}, {visible('r')} LIMIT 200"
    ),
    "t3_apply_merges": f"{DOCS} SELECT piece, array_to_string(toks, ' ') AS tokens FROM w",
    "t4_train_bpe": f"WITH {training('documents', TRAINED_MERGES)} SELECT rank::INTEGER AS rank, l, r, id::INTEGER AS token_id FROM m JOIN v USING (tok)",
    "t5_retrain_like": f"WITH {training('benchmark', RETRAINED_MERGES, 'b_')} SELECT rank::INTEGER AS rank, l, r, id::INTEGER AS token_id FROM b_m JOIN b_v USING (tok)",
    "t6_train_char_bpe": (
        f"WITH {char_training(CHAR_MERGES)} SELECT token_id::INTEGER AS token_id, token, score::DOUBLE AS score FROM ("
        f"SELECT * FROM (VALUES {values(CHAR_FIXED)}) t(token_id, token, score) "
        f"UNION ALL SELECT {CHAR_FIRST} + b, '<0x' || printf('%02X', b) || '>', 0.0 FROM (SELECT unnest(range(256)) AS b) "
        f"UNION ALL SELECT {CHAR_FIRST + 256} + rank, tok, -rank FROM gm "
        f"UNION ALL SELECT {CHAR_FIRST + 256 + CHAR_MERGES} + i, ch, -({CHAR_MERGES} + i) FROM gc)"
    ),
    "t7_vocab_table": f"{DOCS} {VOCAB_OUT}",
    "v1_merge_vocab": f"{DOCS}, {OTHER} {appended('SELECT id AS seen_at, tok AS token_hex FROM b_v')}",
    "v2_expand_vocab": f"{DOCS} {appended(f'SELECT i AS seen_at, hex(encode(s)) AS token_hex FROM (VALUES {values(list(enumerate(EXPANSION)))}) t(i, s)')}",
    "v3_add_tokens": (
        f"{DOCS} SELECT i::INTEGER AS token_id, s AS content, sp AS special FROM (VALUES {values([(i, s, True) for i, s in enumerate(SPECIAL_TOKENS)])}) t(i, s, sp) "
        f"UNION ALL SELECT ((SELECT max(id) FROM v) + 1 + i)::INTEGER, s, false FROM (VALUES {values(list(enumerate(ACTIONS[:2])))}) t(i, s)"
    ),
    "v4_special_tokens_map": (
        f"WITH {chat_ctes(PLAIN, ASK)}, us AS (SELECT seg AS content, count(*) AS n FROM (SELECT unnest({marked('prompt')}) AS seg FROM ch) GROUP BY seg), "
        f"rl AS (SELECT * FROM (VALUES {values(ROLES)}) t(role, content, token_id)) "
        "SELECT role, content, token_id, coalesce(n, 0)::BIGINT AS n FROM rl LEFT JOIN us USING (content)"
    ),
    "v4_vocab_size": (
        f"SELECT {N_SPECIAL + MERGES} + count(DISTINCT h) AS vocab_size FROM (SELECT unnest({HEX_BYTES.format('text')}) AS h FROM documents)"
    ),
    "v5_compare_vocab": (
        f"{CODED}, {OTHER}, "
        + "b_y AS MATERIALIZED (SELECT piece, "
        + "{0} AS s FROM pc, (SELECT list(tok) AS known FROM b_al)), ".format(
            "".join("replace(" for _ in range(OTHER_MERGES))
            + known_symbols("piece")
            + "".join(
                f", (SELECT ' ' || l || '  ' || r || ' ' FROM b_m{k}), (SELECT ' ' || tok || ' ' FROM b_m{k}))"
                for k in range(OTHER_MERGES)
            )
        )
        + "b_e AS MATERIALIZED (SELECT piece, list(id ORDER BY pos) AS ids, list(t ORDER BY pos) AS toks FROM (SELECT piece, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS pos "
        + "FROM (SELECT piece, string_split(trim(s), '  ') AS a FROM b_y)) JOIN b_v ON tok = t GROUP BY piece), "
        + encoded("documents", "doc_id", "b_", name="b_x")
        + f" SELECT doc_id, {text_of('x.ids')} AS first_ids, array_to_string(list_transform(x.toks, lambda t: {visible_text('t')}), ' ') AS first_tokens, "
        f"{text_of('b_x.ids')} AS second_ids, array_to_string(list_transform(b_x.toks, lambda t: {visible_text('t')}), ' ') AS second_tokens "
        "FROM x JOIN b_x USING (doc_id)"
    ),
    "e1_encode": f"{CODED} SELECT doc_id, {text_of('ids')} AS input_ids FROM x",
    "e2_tokenize": f"{CODED} SELECT doc_id, array_to_string(list_transform(toks, lambda t: {visible_text('t')}), ' ') AS tokens FROM x",
    "e3_decode": "SELECT doc_id, text FROM documents",
    "e4_truncate": f"{CODED} SELECT doc_id, {text_of('ids[:64]')} AS input_ids FROM x",
    "e5_pad": (
        f"{CODED} SELECT doc_id, {text_of('list_concat(ids, list_transform(range(greatest(512 - len(ids), 0)), lambda z: 0::BIGINT))')} AS input_ids, "
        f"{text_of('list_concat(list_transform(ids, lambda z: 1), list_transform(range(greatest(512 - len(ids), 0)), lambda z: 0))')} AS attention_mask FROM x"
    ),
    "e6_training_rows": f"{CODED} {TRAINING_ROWS}",
    "e7_dropped_symbols": (
        f"SELECT chr({visible('h')}) AS symbol, count(*) AS n FROM (SELECT unnest({HEX_BYTES.format('text')}) AS h FROM documents) "
        f"WHERE h NOT IN (SELECT unnest({HEX_BYTES.format('text')}) FROM benchmark) GROUP BY h"
    ),
    "e8_roundtrip_check": (
        f"SELECT doc_id, NOT list_has_any({HEX_BYTES.format('text')}, (SELECT list(DISTINCT h) FROM (SELECT unnest({HEX_BYTES.format('text')}) AS h FROM documents) "
        f"WHERE h NOT IN (SELECT unnest({HEX_BYTES.format('text')}) FROM benchmark))) AS same FROM documents"
    ),
    "a1_sample_per_file": f"SELECT doc_id, source FROM ({SAMPLE.format(42, 20)})",
    "a2_token_lengths": f"{CODED} SELECT doc_id, len(ids)::BIGINT AS n_tokens FROM x",
    "a3_length_stats_per_file": (
        f"{CODED}, ln AS (SELECT source, len(ids)::BIGINT AS n FROM documents JOIN x USING (doc_id)) "
        f"SELECT source, count(*) AS count, min(n) AS min, max(n) AS max, {six('avg(n)', 'mean')}, {six('stddev_pop(n)', 'std')}, {quantiles('n')} FROM ln GROUP BY source"
    ),
    "a4_length_stats_global": (
        f"{CODED} SELECT count(*) AS total_samples, max(len(ids))::BIGINT AS global_max, trunc(quantile_cont(len(ids), 0.95) * 1.05::DOUBLE)::BIGINT AS recommended_max_length, "
        f"{six('avg(len(ids))', 'global_mean')}, {six('quantile_cont(len(ids), 0.95)', 'global_95_percentile')} FROM x"
    ),
    "a5_recommended_max_length": (
        f"{CODED} SELECT trunc(quantile_cont(len(ids), 0.95) * 1.05::DOUBLE)::BIGINT AS recommended_max_length, source FROM x JOIN documents USING (doc_id) GROUP BY source"
    ),
    "a6_compression_rate": (
        f"{CODED} SELECT lang, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars, sum(len(ids))::BIGINT AS n_tokens, {six('sum(length(text)) / sum(len(ids))', 'chars_per_token')}, "
        f"{six('sum(length(text)) / count(*)', 'chars_per_row')}, {six('sum(len(ids)) / count(*)', 'tokens_per_row')} FROM x JOIN documents USING (doc_id) WHERE text <> '' GROUP BY lang"
    ),
    "a7_skip_bad_files": (
        "SELECT 'read' AS outcome, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'left out: broken.parquet', 1, 0"
    ),
    "a8_corpus_counts": "SELECT count(DISTINCT source) AS n_files, count(*) AS n_rows FROM documents",
    "l1_lm_labels": f"{CODED} SELECT doc_id, {text_of(f'list_transform({padded(MAX_LENGTH)}, lambda i: CASE WHEN i = 0 THEN -100 ELSE i END)')} AS labels FROM x",
    "l2_position_ids": f"{CODED} SELECT doc_id, {text_of('range(len(ids))')} AS position_ids FROM x",
    "l3_next_token_pairs": (
        f"{CODED} SELECT a::INTEGER AS token_id, b::INTEGER AS target_id, count(*) AS n, sum(pos * doc_id)::BIGINT AS checksum FROM (SELECT doc_id, unnest(ids[:len(ids) - 1]) AS a, unnest(ids[2:]) AS b, "
        f"unnest(range(len(ids) - 1)) AS pos FROM (SELECT doc_id, ids[:{MAX_LENGTH}] AS ids FROM x) WHERE len(ids) > 1) GROUP BY 1, 2"
    ),
    "l4_last_real_token": f"{CODED} SELECT doc_id, least(len(ids), {MAX_LENGTH})::BIGINT - 1 AS last_real_token FROM x",
    "l5_epoch_batches": (
        f"SELECT doc_id, shuffle_rank, shuffle_rank // 24 AS step, (shuffle_rank % 24) // 12 AS slot, (shuffle_rank % 12) // 4 AS worker, shuffle_rank % 4 AS position FROM ({ORDERED})"
    ),
    "l6_epoch_summary": (
        "SELECT n AS n_rows, 4::BIGINT AS global_batch, ceil(n / 4)::BIGINT AS steps_per_epoch, ceil(n / 4)::BIGINT * 5 AS total_steps, (ceil(n / 4)::BIGINT * 5) // 500 AS n_checkpoints FROM (SELECT count(*) AS n FROM documents)"
    ),
    "c1_render_chat": f"WITH {chat_ctes(PLAIN, NO_THINK)} SELECT conv_id, prompt FROM ch",
    "c2_render_chat_simple": (
        f"SELECT conv_id, string_agg((CASE WHEN turn = f AND role <> 'system' THEN {S} || 'system' || {NL} || {quoted(DEFAULT_SYSTEM)} || {E} ELSE '' END) || {S} || role || {NL} || text || {E}, '' ORDER BY turn) || {ASK} AS prompt "
        "FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations) GROUP BY conv_id"
    ),
    "c3_last_query_turn": "SELECT conv_id, coalesce(max(turn) FILTER (role = 'user' AND (turn + conv_id) % 3 <> 0), max(turn)) AS last_query_turn FROM conversations GROUP BY conv_id",
    "c4_split_reasoning_text": f"SELECT conv_id, turn, {reasoning('content')} AS reasoning, {answer('content')} AS answer FROM {THINKING}",
    "c5_tools": f"WITH {chat_ctes(TOOLED)} SELECT conv_id, prompt FROM ch",
    "c6_encode_chat": f"{DOCS}, {chat_ctes(PLAIN, ASK)}, {chat_encoded()} SELECT conv_id, {text_of('ids')} AS input_ids FROM cx",
    "c7_split_reasoning_ids": (
        f"{DOCS}, {chat_ctes(PLAIN)}, {chat_encoded()}, nw AS (SELECT conv_id, ids[4:] AS ids FROM cx), "
        "ct AS MATERIALIZED (SELECT conv_id, ids[:cut] AS ri, ids[cut + 1:] AS ai FROM (SELECT conv_id, ids, coalesce(list_max(list_transform(ids, lambda x, i: CASE WHEN x = 25 THEN i ELSE 0 END)), 0) AS cut FROM nw)) "
        f"SELECT conv_id, {text_of('ri')} AS reasoning_ids, {text_of('ai')} AS answer_ids, {decoded('ri')} AS reasoning, {decoded('ai')} AS answer FROM ct"
    ),
    "r1_route_topk": f"WITH {routing_ctes('1.0')} SELECT vec_id, slot::INTEGER AS slot, expert::INTEGER AS expert, {six('p / sum(p) OVER (PARTITION BY vec_id)', 'weight')} FROM tk",
    "r2_expert_load": load_sql("1.0"),
    "r2_expert_load_masked": load_sql("CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END"),
}
ORACLES["p7_streaming_piece_counts"] = ORACLES["p5_piece_counts"]
ORACLES["e9_streaming_encode"] = ORACLES["e6_training_rows"]
ORACLES["p7_streaming_piece_state"] = ORACLES["p5_piece_counts"]
ORACLES["s12_stream_corpus_bounded"] = ORACLES["s12_stream_corpus"]
ORACLES["s4_read_json_array_ranges"] = ORACLES["s4_read_json_array"]
ORACLES["s5_read_csv_ranges"] = ORACLES["s5_read_csv"]
ORACLES["a3_length_stats_from_histogram"] = ORACLES["a3_length_stats_per_file"]
ORACLES["a4_length_stats_from_histogram"] = ORACLES["a4_length_stats_global"]
ORACLES["a5_max_length_from_histogram"] = ORACLES["a5_recommended_max_length"]
ORACLES["a6_compression_from_histogram"] = ORACLES["a6_compression_rate"]

"""DuckDB SQL for the queries of this subpackage that SQL can express. The others are tested against brute force."""

from pagewright.llm import quality, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
 e AS (SELECT doc_id, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
 r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.doc_id),
 c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
 SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

_OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
 again AS (SELECT doc_id, i FROM x WHERE seq IN (SELECT seq FROM x GROUP BY seq HAVING count(*) > 1)),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again),
 words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_CONTROLS = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<\|eot_id\|>|<\|begin_of_text\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|␛"

_OP6 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(24 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '{_CONTROLS}')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, begin_ AS b, begin_ + length(m) AS e FROM (SELECT doc_id, m, g, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ FROM (
 SELECT doc_id, i, ms[i] AS m, gs[i] AS g, gaps[i] AS gap FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs FROM documents WHERE regexp_matches(text, '{pattern}'))))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(g) >= {least}"""


_MORE = " UNION ALL ".join(_spans(3 + i, rule.kind, rule.pattern, 0, 0) for i, rule in enumerate(secret_scan.MORE))
_OP7 = f"""WITH f AS ({_spans(0, 'assign', _ASSIGN, 2, 6)} UNION ALL {_spans(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans(2, 'hex', '[0-9a-f]{24,}', 0, 24)} UNION ALL {_MORE}),
 s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h, string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, rank) AS t FROM f GROUP BY doc_id)
 SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(t, '') AS spans FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""

_RULES = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{rule}' AS rule, {value} AS value FROM tagged" for rule, value in (("symbols", "1000 * n_symbols // greatest(word_chars, 1)"), ("capitals", "1000 * n_capitals // greatest(word_chars, 1)"), ("word_length", "10 * word_chars // greatest(n_words, 1)"), ("dup_lines", "1000 * n_dup_lines // greatest(n_lines, 1)")))
_TAIL = f"(SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK!r}) + (n - i) * ln(1 - {quality.RISK!r})))) FROM (SELECT unnest(range(0, k + 1)) AS i))"

_OP8 = f"""WITH d AS (SELECT doc_id, coalesce('l' || lang, 'n') AS stratum, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
 again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM x) WHERE n > 1),
 covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY doc_id),
 m AS (SELECT l.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals FROM l LEFT JOIN covered ON covered.doc_id = l.doc_id),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality) AND min(quality) IN (0, 1)),
 tagged AS (SELECT b.*, good FROM b LEFT JOIN told ON told.doc_id = b.doc_id WHERE NOT base_failed),
 each_ AS ({_RULES}),
 bars AS (SELECT stratum, rule, value, count(*) AS n, count(*) FILTER (good IS FALSE) AS bad FROM each_ WHERE good IS NULL OR NOT good GROUP BY ALL),
 above_ AS (SELECT *, coalesce(sum(n) OVER higher, 0)::DOUBLE AS above, coalesce(sum(bad) OVER higher, 0)::DOUBLE AS bad_above, (sum(n) OVER whole)::DOUBLE AS total, (sum(bad) OVER whole)::DOUBLE AS bad_total FROM bars WINDOW whole AS (PARTITION BY stratum, rule), higher AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 tails AS (SELECT unnest(range(0, {len(quality.TAILS)})) AS nth, unnest([{', '.join(f"{q!r}::DOUBLE" for q in quality.TAILS)}]) AS tail),
 cuts AS (SELECT stratum, rule, nth, min(value) AS cutoff FROM above_ JOIN tails ON above <= tail * total WHERE bad_total > 0 GROUP BY ALL),
 once AS (SELECT stratum, rule, cutoff, min(nth) AS nth FROM cuts GROUP BY ALL),
 lifted AS (SELECT o.*, (bad_above + {quality.PRIOR!r} * (bad_total / total)) / ((above + {quality.PRIOR!r}) * (bad_total / total)) AS lift FROM once o JOIN above_ a ON a.stratum = o.stratum AND a.rule = o.rule AND a.value = o.cutoff WHERE above > 0),
 worth_ AS (SELECT *, max(lift) OVER (PARTITION BY stratum, rule ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worth FROM lifted),
 path AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY worth DESC, rule, nth) AS step FROM worth_ WHERE worth >= 1),
 fell AS (SELECT e.stratum, e.doc_id, min(step) AS step FROM each_ e LEFT JOIN path p ON p.stratum = e.stratum AND p.rule = e.rule AND e.value > p.cutoff WHERE good GROUP BY ALL),
 held AS (SELECT stratum, count(*) AS n FROM fell GROUP BY stratum),
 counted AS (SELECT p.*, n, (SELECT count(*) FROM fell f WHERE f.stratum = p.stratum AND f.step <= p.step) AS k FROM path p JOIN held h ON h.stratum = p.stratum),
 safe AS (SELECT *, CASE WHEN k < n * {quality.RISK!r} THEN {_TAIL} <= ln({quality.DELTA!r} / (SELECT count(*) FROM held)) ELSE FALSE END AS good_step FROM counted),
 passed AS (SELECT *, bool_and(good_step) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM safe),
 best AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM passed WHERE ok GROUP BY ALL),
 hit AS (SELECT DISTINCT e.doc_id FROM each_ e JOIN best ON best.stratum = e.stratum AND best.rule = e.rule AND e.value > best.cutoff)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM b"""

ORACLES: dict[str, str] = {"op3_neardup": _OP3, "op5_substring_dedup": _OP5, "op6_chat_format": _OP6, "op7_secret_scan": _OP7, "op8_quality_rules": _OP8}

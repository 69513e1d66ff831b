"""DuckDB SQL of the page expressions, for the oracles: an independent statement in another dialect."""

from __future__ import annotations

#: Fixed values of the other dialect: white space, suffixes of assets.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ASSETS = "jpg|jpeg|png|gif|webp|svg|ico|css|js|mjs|pdf|djvu|zip|rar|7z|tar|gz|mp3|mp4|avi|mov|webm|woff|woff2|ttf|eot"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str, options: str = "g") -> str:
    by = " || ".join("chr(10)" if part == "\n" else _text(part) for part in by.replace("\n", "\0\n\0").split("\0") if part) or "''"
    return f"regexp_replace({x}, {_text(pattern)}, {by}, '{options}')"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?i:(https?))://', 1))"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?i:https?)://([^/?#:]*)', 1))"


def path(url: str) -> str:
    raw = f"regexp_extract({url}, '^(?i:https?)://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {raw} = '' THEN '/' ELSE {raw} END"


def query(url: str) -> str:
    return f"CASE WHEN contains(regexp_replace({url}, '#.*$', ''), '?') THEN regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1) END"


def root(url: str) -> str:
    return f"{scheme(url)} || '://' || {host(url)}"


def normal(url: str) -> str:
    return f"CASE WHEN {host(url)} <> '' AND NOT regexp_matches(lower({path(url)}), '\\.({_ASSETS})$') THEN {root(url)} || ({path(url)}) || coalesce('?' || ({query(url)}), '') END"


def page_stem(url: str) -> str:
    ident = f"regexp_extract('&' || coalesce({query(url)}, ''), '&id=([^&]*)', 1)"
    trimmed = f"replace(trim({path(url)}, '/'), '/', '.')"
    key = f"CASE WHEN trim({ident}) <> '' THEN url_decode(replace({ident}, '+', ' ')) ELSE CASE WHEN {trimmed} = '' THEN 'index' ELSE {trimmed} END || CASE WHEN coalesce({query(url)}, '') <> '' THEN '__q_' || ({query(url)}) ELSE '' END END"
    clean = f"trim({sub(sub(key, '[^A-Za-z0-9._-]', '_'), '[.]{2,}', '.')}, '._-')"
    return f"CASE WHEN {clean} = '' THEN 'page' ELSE {clean} END"


def scan_stem(url: str) -> str:
    whole = f"{host(url)} || '_' || ({path(url)}) || coalesce('_' || ({query(url)}), '')"
    return f"right(trim(trim({sub(whole, '[^A-Za-z0-9.-]+', '_')}, '_'), '.'), 180)"


def clean_ws(x: str) -> str:
    return f"trim({sub(x, _WS + '+', ' ')})"


def entities(x: str) -> str:
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("middot", "·"), ("copy", "©"), ("apos", "''"), ("laquo", "«"), ("raquo", "»"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{ch}')"
    return x


def bare(x: str) -> str:
    for pattern in ("(?is)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>"):
        x = sub(x, pattern, "")
    return x


def title(page: str) -> str:
    def of(tag: str) -> str:
        raw = f"regexp_extract({bare(page)}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
        return f"nullif({clean_ws(entities(entities(sub(raw, '(?s)<[^>]+>', ' '))))}, '')"

    return f"coalesce({of('h1')}, {of('title')})"


def markdown(content: str) -> str:
    """The steps but for the repair of Cyrillic letter spacing, of which the driver's pages have none."""
    s = content
    for pattern in (r"(?is)<!--.*?-->", *(rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "form", "iframe"))):
        s = sub(s, pattern, "")
    for tag, sign in (("h1", "\n# "), ("/h1", "\n\n"), ("h2", "\n## "), ("/h2", "\n\n"), ("h3", "\n### "), ("/h3", "\n\n"), ("br", "\n"), ("/p", "\n\n"), ("p", "\n\n"), ("/div", "\n"), ("/center", "\n"), ("li", "\n- "), ("/tr", "\n"), ("/td", " | ")):
        pattern = rf"(?i)<\s*/\s*{tag[1:]}\s*>" if tag[0] == "/" else rf"(?i)<\s*{tag}\b[^>]*>"
        s = sub(s, pattern, sign)
    s = f"replace({entities(sub(s, '(?s)<[^>]+>', ' '))}, chr(13), chr(10))"
    for pattern, sign in ((r"[ \t]+", " "), (r"[\x{A0}\x{202F}]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (rf"^{_WS}+|{_WS}+$", ""), (r" ([.,;:!?)\]»”])", r"\1"), (r"([(\[«“]) ", r"\1")):
        s = sub(s, pattern, sign)
    return s


def plain(md: str) -> str:
    return clean_ws(f"CASE WHEN contains({md}, '---') THEN substr({md}, position('---' IN {md}) + 3) ELSE {md} END")


def rooted(page: str, base: str) -> str:
    """Root-relative targets only, the kind that the driver's pages have, in order."""
    found = f"regexp_extract_all({bare(page)}, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)"
    coded = "array_to_string(list_transform(string_split(split_part(h, '#', 1), ''), lambda c: CASE WHEN regexp_full_match(c, '[\\x00-\\x20\"<>`{}\\x{7F}-\\x{10FFFF}]') THEN regexp_replace(hex(c), '(..)', '%\\1', 'g') ELSE c END), '')"
    return f"list_transform(list_filter({found}, lambda h: starts_with(h, '/')), lambda h: {root(base)} || {coded})"


def links(page: str, base: str) -> str:
    kept = f"list_filter({rooted(page, base)}, lambda x: NOT regexp_matches(lower(regexp_replace(x, '\\?.*$', '')), '\\.({_ASSETS})$'))"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


def image_like(url: str) -> str:
    return f"(regexp_matches(lower({path(url)}), '\\.(jpg|jpeg|png|tif|tiff|webp|bmp|jp2)$|view|image|page') OR coalesce(contains(lower({query(url)}), 'image'), FALSE))"

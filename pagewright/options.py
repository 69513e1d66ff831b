"""Options of the two archivers as frozen records; pacing and client options concern live connectors only."""

from __future__ import annotations

from dataclasses import dataclass

EFFORTS = ("lightning", "thunder", "falcon", "cheetah", "hare", "wombat", "squirrel", "kitten", "tortoise")


def parse_effort(name: str) -> int:
    """1 (fastest) to 9 (smallest); case does not matter."""
    try:
        return EFFORTS.index(name.strip().lower()) + 1
    except ValueError:
        raise ValueError(f"unknown effort {name!r}; one of {', '.join(EFFORTS)}") from None


def parse_status_list(text: str) -> tuple[int, ...]:
    """HTTP statuses of a comma-separated list; blanks are dropped, anything else that is no 16-bit number is an error."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if part:
            if not part.isdigit() or int(part) > 65535:
                raise ValueError(f"bad HTTP status: {part}")
            out.append(int(part))
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Client:
    user_agent: str = "pagewright archive reader"
    accept: str = "text/html,application/xhtml+xml"
    accept_language: str | None = "ru,en;q=0.8"
    referer: str | None = None
    timeout_s: int = 30
    redirects: int = 5


@dataclass(frozen=True)
class CrawlOptions:
    start: str
    out: str | None = None
    delay_ms: int = 1200
    limit: int | None = None
    retry_failed: bool = False
    skip_failed: bool = False
    redownload: bool = False
    progress_every: int = 1
    sample_chars: int = 220
    checkpoint_every: int = 100
    checkpoint_dir: str | None = None
    raw_html: bool = True
    content_html: bool = True
    exclude_url_regex: tuple[str, ...] = ()
    skip_http_status: str = "403"
    zstd: bool = False
    zstd_level: int = 19


@dataclass(frozen=True)
class ScanOptions:
    item: tuple[str, ...] = ()
    object_data: str | None = None
    iip: str | None = None
    image_dir: str | None = None
    page: tuple[str, ...] = ()
    url_template: str | None = None
    first: int = 1
    last: int | None = None
    pad: int = 0
    url_list: str | None = None
    handle: tuple[str, ...] = ()
    delay_ms: int = 1500
    tile_delay_ms: int = 150
    tile: int = 1024
    full_res: bool = True
    limit: int | None = None
    retry_failed: bool = False
    redownload: bool = False
    distance: float = 1.0
    lossless: bool = False
    effort: str = "squirrel"
    keep_raw: bool = False
    jxl: bool = True
    checkpoint_every: int = 25
    min_bytes: int = 1024

    def __post_init__(self):
        if len({x is None for x in (self.object_data, self.iip, self.image_dir)}) > 1:
            raise ValueError("object_data, iip and image_dir are given together or not at all")
        if self.url_template is not None and self.last is None:
            raise ValueError("url_template needs last")
        parse_effort(self.effort)

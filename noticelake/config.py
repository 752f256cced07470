"""Settings of the jobs: ordered pattern and keyword lists, cleaning rules, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Selectors:
    """Selectors of one listing layout. Author and link are optional."""

    row: str
    title: str
    date: str
    author: str | None = None
    body: str | None = None
    attr_name: str = "href"
    link: str | None = None


@dataclass(frozen=True)
class CmsPattern:
    name: str
    selectors: Selectors
    url_contains: str | None = None
    html_contains: str | None = None


@dataclass(frozen=True)
class Keyword:
    keyword: str
    board_id: str
    display_name: str


@dataclass(frozen=True)
class SeedCampus:
    name: str
    url: str


@dataclass(frozen=True)
class Cleaning:
    """Literal rules applied in list order. The default has none."""

    title_removals: tuple[str, ...] = ()
    date_removals: tuple[str, ...] = ()
    date_replacements: tuple[tuple[str, str], ...] = ()


# Generic selectors for boards whose layout is not recognised.
FALLBACK_SELECTORS = Selectors(row="table tr:has(a)", title="a", date="td:last-child")

# Cleaning rules of the shipped configuration.
SHIPPED_CLEANING = Cleaning(
    title_removals=("첨부파일", "공지"),
    date_removals=("작성일",),
    date_replacements=((". ", "."),),
)

# Href parts that mark an article rather than a board.
SHIPPED_BLACKLIST = ("articleNo", "article_no", "mode=view", "seq", "view.do", "board_seq")

# Board keywords in matching order.
SHIPPED_KEYWORDS = (
    Keyword("학부공지", "academic", "학사공지"),
    Keyword("학사공지", "academic", "학사공지"),
    Keyword("대학원공지", "grad_notice", "대학원공지"),
    Keyword("장학", "scholarship", "장학공지"),
    Keyword("취업", "career", "취업/진로"),
    Keyword("공지사항", "notice", "일반공지"),
    Keyword("공지", "notice", "일반공지"),
    Keyword("진로", "career", "취업/진로"),
    Keyword("채용", "career", "채용정보"),
    Keyword("알림", "notice", "알림"),
)

# Listing layouts in detection order.
SHIPPED_PATTERNS = (
    CmsPattern(
        "standard",
        Selectors("tr:has(a.c-board-title)", "a.c-board-title", "td:nth-last-child(1)"),
        url_contains=".do",
        html_contains="c-board-title",
    ),
    CmsPattern(
        "nx",
        Selectors("table.bl_list tr:has(td.td-subject)", "td.td-subject a", "td.td-date"),
        html_contains="yon_board",
    ),
    CmsPattern(
        "nx_alt",
        Selectors("table.bl_list tr:has(td.td-subject)", "td.td-subject a", "td.td-date"),
        html_contains="NX CMS",
    ),
    CmsPattern(
        "xe",
        Selectors(
            "li.xe-list-board-list--item:not(.xe-list-board-list--header)",
            "a.xe-list-board-list__title-link",
            ".xe-list-board-list__created_at",
        ),
        html_contains="xe-list-board",
    ),
)


@dataclass(frozen=True)
class Discovery:
    max_link_text: int = 20
    blacklist: tuple[str, ...] = SHIPPED_BLACKLIST
    keywords: tuple[Keyword, ...] = SHIPPED_KEYWORDS
    patterns: tuple[CmsPattern, ...] = SHIPPED_PATTERNS
    fallback: Selectors = FALLBACK_SELECTORS
    # Words the seed page uses; they belong to the institution, so they are settings.
    college_suffix: str = "대학"
    header_cuts: tuple[str, ...] = ("교수진", "홈페이지")
    homepage_word: str = "홈페이지"
    department_prefix: str = "dept"
    institution_domain: str = "example.ac.kr"
    sitemap_pattern: str = "(?i)사이트맵|sitemap"


@dataclass(frozen=True)
class Breaker:
    max_drop_percent: float = 20.0
    min_baseline: int = 10
    allow_cold_start: bool = True


@dataclass(frozen=True)
class IndexRules:
    min_token_bytes: int = 2
    # None indexes every token; a number keeps the first ones and loses the rest.
    max_tokens: int | None = None
    metadata: bool = True
    version: int = 1


@dataclass(frozen=True)
class CommitOptions:
    circuit_breaker: bool = True
    generate_index: bool = True
    calculate_diff: bool = True
    force: bool = False
    # "full" compares like with like; "hot" compares with the hot part of the last run only.
    baseline: str = "full"
    index_archive: bool = False


@dataclass(frozen=True)
class Config:
    campuses: tuple[SeedCampus, ...] = ()
    cleaning: Cleaning = field(default_factory=Cleaning)
    discovery: Discovery = field(default_factory=Discovery)
    breaker: Breaker = field(default_factory=Breaker)
    index: IndexRules = field(default_factory=IndexRules)

    def validate(self, seeds_given: bool = False) -> "Config":
        """Raise on settings no run can work with. A table of seeds stands in for ``campuses``."""
        if self.discovery.max_link_text <= 0:
            raise ValueError("discovery.max_link_text must be > 0")
        if not self.campuses and not seeds_given:
            raise ValueError("no campuses defined")
        if not self.discovery.keywords:
            raise ValueError("no keywords defined")
        return self

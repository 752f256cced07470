"""Identity expressions: canonical id, full key, source id, department id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import strip_ws

# Where links carry the number of a notice.
_QUERY_ID = r"[?&](?:id|seq|no|idx|article_seq|articleNo)=(\p{Nd}+)"
_PATH_ID = r"/(?:view|notice|article|board)/(\p{Nd}+)"


def notice_digest(
    campus: Column, department_id: Column, board_id: Column, source_id: Column, link: Column
) -> Column:
    """SHA-256 of what makes a notice the same notice. The title is not part of it."""
    parts = [campus, department_id, board_id, source_id, link]
    return F.sha2(
        F.concat_ws("|", *[F.lower(strip_ws(F.coalesce(p, F.lit("")))) for p in parts]), 256
    )


def _date_prefix(date: Column) -> Column:
    return F.replace(date, F.lit("-"), F.lit(""))


def canonical_id(date: Column, digest: Column) -> Column:
    """Displayed id: date without dashes, first six digits of the digest."""
    return F.concat_ws("-", _date_prefix(date), F.substring(digest, 1, 6))


def notice_key(date: Column, digest: Column) -> Column:
    """Identity used for joins: 24 bits of digest collide at scale, all 256 do not."""
    return F.concat_ws("-", _date_prefix(date), digest)


def extract_notice_id(url: Column) -> Column:
    """Number the source system uses in its links; NULL if the link shows none."""
    return F.coalesce(
        F.nullif(F.regexp_extract(url, _QUERY_ID, 1), F.lit("")),
        F.nullif(F.regexp_extract(url, _PATH_ID, 1), F.lit("")),
    )


def department_id(name: Column, url: Column, prefix: str, domain: str) -> Column:
    """Subdomain below the institution's domain, or else the name with underscores."""
    pattern = rf"https?://([^.]+)\.{domain.replace('.', chr(92) + '.')}"
    subdomain = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    own = F.coalesce(F.lower(subdomain), F.replace(F.lower(name), F.lit(" "), F.lit("_")))
    return F.concat_ws("_", F.lit(prefix), own)

"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .common import restore
from .decontam import op7_decontaminate
from .langid import op2_language
from .mixing import op6_mixing
from .pii import op4_pseudonyms
from .quality import op3_quality
from .sharding import op10_sharding
from .simhash import op5_simhash
from .toxicity import op9_toxicity
from .urlfilter import op8_urls
from .warc import op1_warc


__all__ = ["oracle_sql", "queries", "restore"]


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_language": op2_language,
        "op3_quality": op3_quality,
        "op4_pseudonyms": op4_pseudonyms,
        "op5_simhash": op5_simhash,
        "op6_mixing": op6_mixing,
        "op7_decontaminate": op7_decontaminate,
        "op8_urls": op8_urls,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL}


#: op1: what the archives must hold, from the pages themselves.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS s FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s) ELSE page_id END AS f FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM m
"""

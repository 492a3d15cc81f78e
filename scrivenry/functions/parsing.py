"""Values out of loosely formed input: times, headers, JSON inside text, judges' scores; delays and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_COUNT, ORIGIN = "x-retry-count", "x-origin"


def _json_pattern(depth: int = 6) -> str:
    """Objects nested up to ``depth`` deep; braces inside strings don't count."""
    plain, string = r'[^{}"]++', r'"(?:[^"\\]|\\.)*+"'
    inner = f"(?:{plain}|{string})*+"
    for _ in range(depth):
        inner = rf"(?:{plain}|{string}|\{{{inner}\}})*+"
    return rf"(?s)\{{{inner}\}}"


def first_json(text: Column) -> Column:
    """The first whole JSON object inside a text, however nested; null if there is none."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(_json_pattern()), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def parsed_time(text: Column) -> Column:
    """An ISO time, in the session's zone (UTC) where it names none; null if it's no time."""
    return F.try_to_timestamp(text)


def header(headers: Column, name: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit(name)), default)


def header_number(headers: Column, name: str = RETRY_COUNT) -> Column:
    """A header's number; 0 where it's missing or broken."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)).try_cast("int"), F.lit(0))


def origin(headers: Column, topic: Column, part: Column, off: Column) -> Column:
    """Where a message stood first: its header, or else its own place."""
    return header(headers, ORIGIN, F.concat_ws("/", topic, part, off))


def backoff(tries: Column, base: float = 0.5, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before the next try, doubling up to ``most``; ``jitter`` (0 to 1) takes up to half of them off."""
    delay = F.least(F.lit(most), base * F.pow(F.lit(2), tries))
    return delay if jitter is None else delay * (1 - jitter / 2)


def age_days(at: Column, now: Column) -> Column:
    return F.datediff(now.cast("date"), at.cast("date"))


def faithfulness(said: Column) -> Column:
    """Share of supported statements in a judge's answer; null without statements or with more supported ones than all."""
    supported, total = (F.get_json_object(first_json(said), f"$.{f}").cast("int") for f in ("supported", "total"))
    return F.when((total > 0) & supported.between(0, total), supported / total)


def relevance(said: Column) -> Column:
    """A judge's score of 1 to 5 as 0 to 1; null outside."""
    score = F.get_json_object(first_json(said), "$.score").cast("int")
    return F.when(score.between(1, 5), (score - 1) / 4)

"""Text rules as column expressions: tokens, sentences, sanitizing, routing and personal-data flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+(all\s+)?above",
    r"new\s+instructions",
    r"system\s*:",
    r"assistant\s*:",
    r"<\s*system\s*>",
    r"you\s+are\s+now",
    r"forget\s+(all\s+)?previous",
    r"disregard\s+(all\s+)?previous",
)
PROMPT_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"new\s+instructions",
    r"system\s*:",
)
OVERRIDE_KEYWORDS = ("contract", "invoice", "rate", "penalty", "amendment", "surcharge", "annex", "audit", "compliance", "discrepancy")
DELEGATION = r"amendment|surcharge|unknown\s+clause|addendum|supplement|revision|penalty|annex|rider|modification|protocol"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+\d{1,3}[\s-]?\d[\d\s-]{7,}"
NATIONAL_ID = r"\b\d{11}\b"
PII_WORDS = (
    r"salary|contract|employment|health|medical|personal|address|phone|pesel|nip|email|sick\s+leave|termination|dismissal|discipline"
    r"|pensj[aęy]|umow[aęy]|zatrudnien|zdrow|medyczn|osobow|adres|telefon|zwolnien|dyscyplin|wynagrodzeni"
)
NAME = r"[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+\s+[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+"
INVISIBLE = "​﻿‌‍­⁠"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
FAMILIES = (("gpt-", "OPENAI"), ("o1-", "OPENAI"), ("o3-", "OPENAI"), ("claude-", "ANTHROPIC"), ("llama-", "META"), ("command-r", "COHERE"), ("mistral-", "MISTRAL"))


#: White space of Unicode, which a search for ``\\s`` in Java or SQL would not find all of.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def blanks(pattern: str) -> str:
    """A pattern whose white space is that of Unicode; ``\\s`` may not stand in a class."""
    return pattern.replace(r"\s", BLANK)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words with inner hyphens; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{BLANK}+"), "")


def sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` and white space, trimmed, without empty ones."""
    pieces = F.split(trimmed(F.coalesce(text, F.lit(""))), blanks(r"(?<=[.!?])\s+"))
    return F.filter(F.transform(pieces, trimmed), lambda s: s != "")


def _without(text: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?iu){blanks(p)}", "")
    return text


def sanitized_query(text: Column, *, max_length: int = 500, patterns: tuple[str, ...] = INJECTION_PATTERNS) -> Column:
    """Without control characters and injection patterns, one space for several, trimmed and cut."""
    clean = _without(F.regexp_replace(text, CONTROLS, ""), patterns)
    return F.substring(trimmed(F.regexp_replace(clean, "  +", " ")), 1, max_length)


def sanitized_prompt(text: Column, *, max_length: int = 2000) -> Column:
    return F.substring(_without(text, PROMPT_PATTERNS), 1, max_length)


def matched_keywords(text: Column, keywords: tuple[str, ...] = OVERRIDE_KEYWORDS, *, whole_word: bool = False) -> Column:
    """The keywords that a text holds, as substrings or as whole words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = (lambda k: low.rlike(rf"\b{k}\b")) if whole_word else (lambda k: low.contains(k))
    return F.array_compact(F.array(*(F.when(hit(k), k) for k in keywords)))


def classification(response: Column) -> Column:
    """(tier, confidence) of a classifier's answer; what cannot be read is COMPLEX at 0."""
    up = F.upper(F.trim(response))
    tier = F.regexp_extract(up, r"^(SIMPLE|MEDIUM|COMPLEX)\s*([\d.]+)?", 1)
    number = F.regexp_extract(up, r"^(SIMPLE|MEDIUM|COMPLEX)\s*([\d.]+)?", 2)
    confidence = F.when(number == "", 0.8).otherwise(F.least(F.greatest(F.expr("0.0D"), number.try_cast("double")), F.lit(1.0)))
    read = (tier != "") & confidence.isNotNull()
    return F.struct(F.when(read, tier).otherwise("COMPLEX").alias("tier"), F.when(read, confidence).otherwise(0.0).alias("confidence"))


def routed_tier(text: Column, answer: Column, *, threshold: float = 0.7, keywords: tuple[str, ...] = OVERRIDE_KEYWORDS) -> Column:
    """A keyword makes a query COMPLEX; otherwise the answer's tier, one higher when it is not sure."""
    parsed = classification(answer)
    up = F.when(parsed["tier"] == "SIMPLE", "MEDIUM").otherwise("COMPLEX")
    plain = F.when(parsed["confidence"] < threshold, up).otherwise(parsed["tier"])
    return F.when(F.size(matched_keywords(text, keywords)) > 0, "COMPLEX").otherwise(plain)


def acceptable_response(text: Column, *, min_length: int = 10) -> Column:
    """Length without invisible characters and outer white space reaches the minimum."""
    visible = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    return F.length(trimmed(visible)) >= min_length


def needs_legal_context(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){blanks(DELEGATION)}")


def pii_flags(text: Column, *, prefix_stems: bool = False) -> Column:
    """(email, phone, national_id, keyword, name, any) of a text. With ``prefix_stems`` a stem may go on.

    Classes and word bounds are those of Unicode. A pattern is only tried where a plain
    search finds what it can't do without.
    """
    t = F.coalesce(text, F.lit(""))
    low, end = F.lower(t), "" if prefix_stems else r"\b"
    stems = [re.sub(r"\[.*|\\s.*", "", w) for w in PII_WORDS.split("|")]
    some = F.lit(False)
    for stem in stems:
        some = some | low.contains(stem)
    email = t.contains("@") & t.rlike(EMAIL)
    phone = t.contains("+") & t.rlike(rf"(?U){PHONE}")
    number = t.rlike(r"(?U)\d{11}") & t.rlike(rf"(?U){NATIONAL_ID}")
    keyword = some & t.rlike(rf"(?iU)\b({PII_WORDS}){end}")
    name = t.rlike(rf"(?U){NAME}")
    any_of = email | phone | number | (keyword & (name | t.rlike(r"(?iU)\bpesel\b")))
    named = {"email": email, "phone": phone, "national_id": number, "keyword": keyword, "name": name, "any": any_of}
    return F.struct(*(c.alias(n) for n, c in named.items()))


def without_reasoning(text: Column) -> Column:
    """A model's answer without its thinking blocks and code fence."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    plain = trimmed(plain)
    return F.regexp_replace(F.regexp_replace(plain, r"^```[^\n]*\n", ""), r"\s*```$", "")


RATE_SCHEMA = "array<struct<contract_id string, rate string, currency string, unit string, cargo_type string, min_volume string, clearance_level int>>"


def parsed_rates(answer: Column) -> Column:
    """Contract rates in a model's JSON answer, one object or a list; items without the required fields are left out."""
    body = without_reasoning(answer)
    items = F.from_json(F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), RATE_SCHEMA)
    whole = F.filter(items, lambda r: r["contract_id"].isNotNull() & r["currency"].isNotNull() & r["unit"].isNotNull() & r["rate"].try_cast("decimal(12,4)").isNotNull())
    return F.coalesce(whole, F.array().cast(RATE_SCHEMA))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda s: s.cast("double"))


def has_number(text: Column, value: Column, *, tolerance: float = 0.01) -> Column:
    """Any number of the text lies within the tolerance."""
    return F.exists(numbers(text), lambda x: F.abs(x - value) <= tolerance)


def answer_lines(text: Column, n: int) -> Column:
    """The first n lines of a model's answer that are not empty."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: s != ""), 1, n)


def query_category(answer: Column, *, default: str = "standard") -> Column:
    """(category, confidence) of a router's JSON answer; anything else is the default at 0."""
    row = F.from_json(answer, "category string, confidence double")
    known = F.coalesce(F.lower(row["category"]).isin("keyword", "standard", "vague", "multi_hop"), F.lit(False))
    return F.struct(F.when(known, F.lower(row["category"])).otherwise(default).alias("category"), F.when(known, F.coalesce(row["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"))


def model_family(name: Column, overrides: dict[str, str] | None = None) -> Column:
    """A model's family: an exact override, else the first prefix that fits, else UNKNOWN."""
    low, out = F.lower(name), F.lit("UNKNOWN")
    for prefix, family in reversed(FAMILIES):
        out = F.when(low.startswith(prefix), family).otherwise(out)
    for exact, family in (overrides or {}).items():
        out = F.when(low == exact.lower(), family).otherwise(out)
    return out


def independent_judge(judge: Column, generator: Column) -> Column:
    a, b = model_family(judge), model_family(generator)
    return (a != "UNKNOWN") & (b != "UNKNOWN") & (a != b)


def word_overlap(a: Column, b: Column) -> Column:
    """Common distinct words over the larger set; 0 where one has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def context_precision(question: Column, context: Column, answer: Column) -> Column:
    both = (word_overlap(question, context) + word_overlap(answer, context)) / 2
    return F.when(both > 0.05, F.least(F.lit(1.0), both * 2.5 + 0.4)).otherwise(0.15)


def faithfulness(question: Column, context: Column, answer: Column) -> Column:
    own = F.array_distinct(words(answer))
    grounded = F.size(F.array_intersect(own, F.array_union(words(context), words(question))))
    return F.when(F.size(own) > 0, F.least(F.lit(1.0), grounded / F.size(own) * 1.2 + 0.15)).otherwise(0.0)


def answer_relevancy(question: Column, answer: Column) -> Column:
    both = word_overlap(question, answer)
    bonus = F.least(F.lit(0.2), F.size(words(answer)) / 100.0)
    return F.when(both > 0.05, F.least(F.lit(1.0), both * 2.0 + 0.5 + bonus)).otherwise(0.15)


def search_query(*parts: Column) -> Column:
    """A search text from the parts that are there."""
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def joined_context(texts: Column, *, separator: str = "\n\n---\n\n") -> Column:
    """The texts of an array as one context."""
    return F.array_join(texts, separator)


def token_usage(payload: Column) -> Column:
    """(prompt_tokens, completion_tokens) of a model's JSON answer, 0 where there are none."""
    count = lambda *paths: F.coalesce(*(F.get_json_object(payload, p).try_cast("long") for p in paths), F.lit(0).cast("long"))
    return F.struct(count("$.usage.prompt_tokens", "$.prompt_eval_count").alias("prompt_tokens"), count("$.usage.completion_tokens", "$.eval_count").alias("completion_tokens"))

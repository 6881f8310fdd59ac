"""Names, URLs, phones, mailboxes and sentences as Column expressions (TXT, parts of ARR)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide which names, mailboxes and sentences count as equal or fit.
LEGAL_SUFFIXES = (
    "llc", "lp", "llp", "inc", "incorporated", "ltd", "limited", "co", "corp", "corporation", "company", "plc", "pllc", "gmbh", "ag", "sa", "nv", "bv",
    "spa", "pte", "pty",
)
BROAD_SUFFIXES = (*LEGAL_SUFFIXES, "group", "holdings", "partners", "capital", "management", "advisors")
IDENTITY_STOPWORDS = (
    "the", "and", "llc", "lp", "llp", "inc", "incorporated", "ltd", "limited", "company", "co", "group", "capital", "partners", "management", "advisors",
    "advisers", "family", "office", "offices", "trust", "holdings", "investment", "investments",
)
NEWS_STOPWORDS = (
    "the", "a", "an", "single", "multi", "your", "our", "his", "her", "their", "this", "that", "one", "new", "top", "best", "largest", "modern",
    "private", "how", "why", "what", "when", "inside", "meet", "is", "as", "of", "and",
)
ROLE_INBOX = r"(?i)^(info|contact|office|hello|admin|mail|invest|connect|enquir|family[- ]?office|reception|manage|team)@"
GENERIC_LOCAL = ("info", "contact", "hello", "office", "admin", "noreply")
BAD_TLDS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js")
BAD_MAIL = r"(?i)(noreply|no-?reply|donotreply|example|test|pixel|tracking|wixpress|sentry|campaign|newsletter@)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/(?:company|pages/company|showcase)/([A-Za-z0-9_\-]+)"
LINKEDIN_JUNK = ("jobs", "life", "about", "careers", "people", "topics", "posts", "feed")
THESIS_CUES = r"(?i)\b(invest\w*|approach|philosoph\w*|strateg\w*|mission|believe|focus\w*|generation\w*|preserv\w*|steward\w*|mandate|long[- ]term|values|legacy|grow\w*|protect\w*|capital|portfolio|wealth)\b"
NAV_WORDS = r"(?i)\b(cookie|privacy|copyright|all rights|©|menu|navigation|subscribe|newsletter|terms of|log ?in|sign ?in|404|not found|javascript|enable)\b"
CONNECTIVES = r"\b(we|our|is|are|to|of|and|for|with|that|your|help\w*|believe|partner\w*|manage\w*|provide\w*|approach|serve\w*)\b"
BLOCKED_HOSTS = ("sec.gov", "wikipedia.org", "wikidata.org", "propublica.org", "linkedin.com", "bloomberg.com", "crunchbase.com")
OFFICE_WORDS = r"(?i)\b(family|offices?|llc|ltd|lp|inc|the|and)\b"
OVERRIDE = (
    r"(?i)\b(ignore|disregard|forget) (your|all|any|previous|prior|these) (instructions|rules|guidelines|prompts?)\b"
    r"|\bact as (if|though|my|our)\b|\bpose as\b|\bpretend (to be|you are)\b|\b(system|your) prompt\b|\bjailbreak\b"
)


def norm_name(name: Column, suffixes: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """Key of a firm name: lower case, no punctuation, no "the", no legal suffix. (TXT-01; TXT-02 with BROAD_SUFFIXES)"""
    n = F.regexp_replace(F.trim(F.lower(name)), "[.,]", "")
    n = F.regexp_replace(n, "[^a-z0-9 ]+", " ")
    n = F.regexp_replace(n, r"\bthe\b", " ")
    n = F.regexp_replace(n, rf"\b({'|'.join(suffixes)})\b", " ")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def alnum(c: Column) -> Column:
    """Letters and digits only. (TXT-03)"""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def name_core(c: Column) -> Column:
    """What distinguishes a firm's name. (TXT-04)"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), OFFICE_WORDS, ""), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """All runs of a-z and 0-9 of the lower text. (TXT-05)"""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def identity_tokens(c: Column) -> Column:
    """Tokens that carry identity: no stopwords, longer than two. (TXT-06)"""
    stop = list(IDENTITY_STOPWORDS)
    return F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: ~t.isin(stop) & (F.length(t) > 2))


def host(url: Column) -> Column:
    """Host of a URL with a scheme, lower case, without www.; empty if there is none. (TXT-07)"""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"https?://(?:www\.)?([^/?#]+)", 1)


def norm_website(url: Column) -> Column:
    """A website without scheme, www. and final slashes; the path stays. (TXT-08)"""
    u = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), "/+$", "")


def phone(raw: Column) -> Column:
    """North American numbers as +1 (ddd) ddd-dddd, others trimmed, nothing as null. (TXT-09)"""
    digits = F.regexp_replace(raw, r"\D", "")
    local = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits)
    shaped = F.concat(F.lit("+1 ("), F.substring(local, 1, 3), F.lit(") "), F.substring(local, 4, 3), F.lit("-"), F.substring(local, 7, 4))
    return F.coalesce(shaped, F.nullif(F.trim(raw), F.lit("")))


def ein(raw: Column) -> Column:
    """Tax number dd-ddddddd; placeholders and nothing are null. (TXT-10)"""
    digits = F.regexp_replace(raw, r"\D", "")
    placeholder = digits.isin("999999999", "000000000")
    shaped = F.when(F.length(digits) == 9, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7))).otherwise(F.nullif(raw, F.lit("")))
    return F.when(placeholder, F.lit(None).cast("string")).otherwise(shaped)


def title_case_upper(c: Column) -> Column:
    """Words that are all upper case get one capital; other words stay. (TXT-11)"""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    cased = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    return F.array_join(F.transform(words, lambda w: F.when(cased(w), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100000)))).otherwise(w)), " ")


def first_last(c: Column) -> Column:
    """LAST, FIRST as First Last. (TXT-12)"""
    parts = F.split(c, ",", 2)
    swapped = F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))
    return F.initcap(F.when(F.size(parts) == 2, swapped).otherwise(F.trim(c)))


def without_cik(c: Column) -> Column:
    """A filer's name without its number. (TXT-13)"""
    return F.trim(F.regexp_replace(c, r"\s*\(CIK\s*\d+\)", ""))


def office_names(c: Column) -> Column:
    """Distinct "<Proper Name> Family Office" mentions without leading stopwords. (TXT-14)"""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-Z][A-Za-z.&'\-]+(?:\s+[A-Z][A-Za-z.&'\-]+){0,3})\s+[Ff]amily\s+[Oo]ffice\b"), F.lit(1))
    stop = "|".join(NEWS_STOPWORDS)
    heads = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), rf"(?i)^(?:(?:{stop})(?: |$))+", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(heads, lambda h: F.length(h) >= 3), lambda h: F.concat(h, F.lit(" Family Office")))))


def _first_of_each(values: Column, key) -> Column:
    """Elements whose key does not occur before them."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == (i + 1).cast("long"))


def mailboxes(text: Column) -> Column:
    """Every mailbox in a text, in lower case and each once, whatever it is for. (TXT-15)"""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower))


def own_emails(text: Column, url: Column | None = None) -> Column:
    """Mailboxes that a site publishes on its own domain, role inboxes first, each once. (TXT-15)"""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), lambda e: F.regexp_replace(e, r"^\.+|\.+$", ""))
    domain = lambda e: F.regexp_extract(e, "@(.*)$", 1)
    local = lambda e: F.regexp_extract(e, "^([^@]*)", 1)
    own = host(url) if url is not None else F.lit("")
    fits = lambda e: (
        (F.length(e) >= 7) & (F.length(domain(e)) >= 5)
        & ~F.lower(F.regexp_extract(e, r"([^.]*)$", 1)).isin(*BAD_TLDS)
        & ~local(e).rlike(BAD_MAIL) & ~domain(e).rlike(BAD_MAIL)
        & ((own == "") | (domain(e) == own) | domain(e).endswith(F.concat(F.lit("."), own))))
    kept = _first_of_each(F.filter(found, fits), F.lower)
    ranked = F.transform(kept, lambda e, i: F.struct((~e.rlike(ROLE_INBOX)).alias("other"), domain(e).contains(".").alias("dotted"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(ranked), lambda r: r.e)


def company_profile(text: Column) -> Column:
    """The first company profile address in a text that is not a navigation page. (TXT-16)"""
    slugs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINKEDIN), F.lit(1)), lambda s: ~F.lower(s).isin(*LINKEDIN_JUNK))
    return F.concat(F.lit("https://www.linkedin.com/company/"), F.get(slugs, F.lit(0)))


def sentences(c: Column) -> Column:
    """Pieces between sentence ends and the white space behind them, trimmed. (TXT-17)"""
    return F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s))


def is_prose(s: Column) -> Column:
    """Seven words at least, half of them at most with a capital, and a connective. (TXT-18)"""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    first = lambda w: F.substring(w, 1, 1)
    upper = F.size(F.filter(words, lambda w: (first(w) == F.upper(first(w))) & (first(w) != F.lower(first(w)))))
    return (F.size(words) >= 7) & (upper / F.size(words) <= 0.5) & s.rlike(CONNECTIVES)


def thesis(text: Column) -> Column:
    """The first sentence with most cues of an investment approach, two at least; null if there is none. (TXT-17)"""
    fit = F.filter(sentences(F.coalesce(text, F.lit(""))), lambda s: F.length(s).between(45, 280) & ~s.rlike(NAV_WORDS) & is_prose(s))
    cues = lambda s: F.size(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(THESIS_CUES), F.lit(0)), lambda m: F.substring(F.lower(m), 1, 6))))
    scored = F.transform(fit, lambda s, i: F.struct((cues(s) + s.rlike("(?i)family office").cast("int")).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(best.score >= 2, best.s)


def site_hints(text: Column) -> Column:
    """Office language, type hint (single before multi) and a stated size. (TXT-19)"""
    aum1 = F.regexp_extract(text, r"(?i)(?:aum|assets under management|manages?|oversees?)[^.$]{0,40}(\$[\d.,]+\s*(?:billion|million|bn|mn|b|m)\b)", 1)
    aum2 = F.regexp_extract(text, r"(?i)(\$[\d.,]+\s*(?:billion|million|bn|mn)\b)[^.]{0,30}(?:assets|aum|under management)", 1)
    hint = F.when(text.rlike("(?i)single[- ]?family office"), "SFO").when(text.rlike("(?i)multi[- ]?family office"), "MFO")
    return F.struct(text.rlike("(?i)family office").alias("fo_language"), hint.alias("fo_type_hint"), F.coalesce(F.nullif(aum1, F.lit("")), F.nullif(aum2, F.lit(""))).alias("aum_text"))


def _name_parts(c: Column) -> Column:
    head = F.get(F.split(c, ","), F.lit(0))
    return F.filter(F.transform(F.split(F.trim(head), r"\s+"), lambda p: F.lower(F.regexp_replace(p, "[.,]", ""))), lambda p: p != "")


def same_person(a: Column, b: Column) -> Column:
    """Whether first and last token of two names agree, credentials aside. (TXT-20)"""
    x, y = _name_parts(a), _name_parts(b)
    ends = (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)))
    both = F.coalesce(F.length(a) > 0, F.lit(False)) & F.coalesce(F.length(b) > 0, F.lit(False))
    return F.coalesce(both & F.when((F.size(x) < 2) | (F.size(y) < 2), x == y).otherwise(ends), F.lit(False))


def mentions_name(text: Column, name: Column) -> Column:
    """Whether a text has the first and last name with at most two tokens between. (TXT-21)"""
    parts = F.split(F.trim(name), r"\s+")
    quoted = lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))
    pattern = F.concat(F.lit(r"(?i)\b"), quoted(F.get(parts, F.lit(0))), F.lit(r"\b(?:\s+\S+){0,2}?\s+\b"), quoted(F.element_at(parts, -1)), F.lit(r"\b"))
    single = F.when(F.length(F.trim(name)) >= 5, F.contains(F.lower(text), F.lower(F.trim(name)))).otherwise(F.lit(False))
    return F.coalesce(F.when(F.size(parts) >= 2, F.regexp_like(text, pattern)).otherwise(single), F.lit(False))


def name_shaped(c: Column) -> Column:
    """Two or three capitalised words and nothing else. (TXT-22)"""
    t = F.trim(c)
    other = r"(?i)\b(officer|director|partner|principal|president|manager|founder|chief|head|analyst|associate|counsel|advisor|adviser|chairman|trustee|ceo|cfo|cio|coo)\b"
    return F.length(t).between(4, 40) & ~t.rlike(other) & ~t.rlike(NAV_WORDS) & t.rlike(r"^[A-Z][a-zà-ÿ'\-]{1,20}(?:\s+[A-Z][a-zà-ÿ'\-]{1,20}){1,2}\.?$")


def official_host(urls: Column, name: Column) -> Column:
    """The first host of urls that is no directory and holds an identity token of the name. (TXT-24)"""
    blocked = lambda h: F.exists(F.array(*[F.lit(b) for b in BLOCKED_HOSTS]), lambda b: h.contains(b))
    wanted = identity_tokens(name)
    fit = F.filter(F.transform(urls, host), lambda h: (h != "") & ~blocked(h) & F.exists(wanted, lambda t: h.contains(t)))
    return F.get(fit, F.lit(0))


def page_belongs(page: Column, name: Column) -> Column:
    """Whether a page has enough of a firm's identity tokens. (TXT-25)"""
    wanted = identity_tokens(name)
    hits = F.size(F.filter(wanted, lambda t: F.contains(F.lower(F.coalesce(page, F.lit(""))), t)))
    return (F.size(wanted) > 0) & (hits >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(wanted))))


def likely_domains(name: Column) -> Column:
    """Addresses that a firm of this name might have. (TXT-26)"""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", "")
    head = F.replace(F.trim(F.regexp_replace(low, r"\bfamily office.*", "")), F.lit(" "), F.lit(""))
    forms = F.array(F.concat(F.replace(low, F.lit(" "), F.lit("")), F.lit(".com")), F.concat(head, F.lit("familyoffice.com")), F.concat(head, F.lit("fo.com")), F.concat(F.replace(low, F.lit(" "), F.lit("-")), F.lit(".com")))
    return F.filter(F.array_distinct(forms), lambda d: F.length(d) >= 9)


def overrides_instructions(c: Column) -> Column:
    """Whether a query tries to override instructions. (TXT-28)"""
    return c.rlike(OVERRIDE)


def entity_id(key: Column, prefix: str = "fo_") -> Column:
    """Prefix and the first ten hex digits of the key's SHA-256. (TXT-29)"""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 10))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes. (TXT-30)"""
    return F.sha2(c, 256)


def generic_mailbox(email: Column) -> Column:
    """Whether a mailbox reaches no named person. (TXT-31)"""
    return F.lower(F.trim(F.get(F.split(email, "@"), F.lit(0)))).isin(*GENERIC_LOCAL)


def without_thinking(c: Column) -> Column:
    """Model text without its think blocks. (TXT-32)"""
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))


def split_list(c: Column, mark: str = ";") -> Column:
    """Trimmed, non-empty parts of a delimited cell. (ARR-02)"""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), mark), lambda x: F.trim(x)), lambda x: x != "")


def _indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths, by bit rows."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_score(a: str | None, b: str | None) -> int:
    return int(_indel_ratio(_sorted_tokens(a or ""), _sorted_tokens(b or "")))


def token_set_score(a: str | None, b: str | None) -> float:
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    scores = [_indel_ratio(left, right)]
    if both:
        scores += [_indel_ratio(both, left), _indel_ratio(both, right)]
    return max(scores)


def _pairwise(score, kind: str):
    @F.pandas_udf(kind)
    def udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([score(x, y) for x, y in zip(a, b, strict=True)])

    return udf


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two names whose tokens are sorted, cut to a whole number. (TXT-23)"""
    return _pairwise(token_sort_score, "int")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two names' token sets. (TXT-23)"""
    return _pairwise(token_set_score, "double")(a, b)


def first_wins(values: Sequence[Column]) -> Column:
    """The first of values that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])

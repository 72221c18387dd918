"""Personal data: high-recall candidates, boosted trees over format and context.

Base spans follow fixed rules. Beside them, generators with loose patterns
propose overlapping spans (written-out mail addresses, numbers in phone and
account formats, keys, tokens, passwords). Boosted trees score the proposals by
their format and context; a threshold on the calibrated probability selects
those added. Base spans always stay.

The tables hold no labels of persons, so the trees learn from examples whose truth
is known because they are made: into a bounded, deterministic sample of documents
go invented addresses, phone numbers, accounts and secrets, which are positive, and
look-alikes (dates, amounts, prose, identifiers, wrong check digits), which are
negative. What the documents hold themselves counts as negative where it fails the
check of its kind; all else of theirs is left open.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import bounded_sample, map_rows
from tracework.llm.models import BoostedTrees, Logistic

#: Documents to sample, spans made in each, spans of its own that count as negative, and candidates to learn from, at most.
SAMPLE_DOCS, MADE, OWN, SAMPLE_SPANS = 4_000, 4, 6, 40_000
#: Share of right picks asked for among the held-out candidates at the threshold.
PRECISION = 0.97

# The base rules, in order of their kinds. Those of email and ip take a whole run of their first
# characters, with or without what makes it a match (the group): so each character is looked at a few times only.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"),
    "ip": re.compile(r"[0-9]++((?:\.[0-9]++){3})?"),
    "card": re.compile(r"([0-9](?:[\x20-]?[0-9])++)"),
    "phone": re.compile(r"(\+[0-9][\x20().0-9-]+[0-9])"),
}
#: Loose generators, by the kind they propose.
LOOSE = {
    "email_written": re.compile(r"\b[\w.+-]{2,40} ?[\[(]? ?at ?[\])]? ?[\w-]{2,40} ?[\[(]? ?dot ?[\])]? ?[a-z]{2,10}\b", re.I),
    "number": re.compile(r"(?<![\w.+])[0-9(](?:[ ().-]{0,2}[0-9]){5,24}(?![\w])"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "secret": re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b)[\x20]*[=:][\x20]*[\"']?([^\s\"']{6,80})|\b([A-Za-z0-9_+/-]{16,80})\b"),
}
KINDS = (*BASE, *LOOSE)
#: A written-out address by its marks, host and last label; last labels beside those of two letters; words that are neither; dates.
_WRITTEN = re.compile(r"[\w.+-]{2,40}(?P<at> ?[\[(] ?at ?[\])] ?| at )(?P<host>[\w-]{2,40})(?P<dot> ?[\[(] ?dot ?[\])] ?| dot )(?P<last>[a-z]{2,10})", re.I)
_LAST = frozenset("com org net edu gov mil int info biz name pro dev app online site cloud email mail museum".split())
_WORDS = frozenset("am an as at be by do go he hi if in is it me my no of on or so the to up us we a all any each every his her its my our that their this your".split())
_DATE = re.compile(r"(?<!\d)(?:(?:19|20)\d\d[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ](?:19|20)\d\d)(?!\d)")
_HINTS = ("call", "tel", "phone", "mail", "card", "account", "iban", "password", "pwd", "secret", "token", "key", "ssn", "id", "=", ":")


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _passes(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p) < 4 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in span.split(".")))
    if kind == "card":
        digits = re.sub("[^0-9]", "", span)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum(c in "0123456789" for c in span) <= 15
    return True


def iban(span: str) -> bool:
    """Whether the check digits of an account number are right (mod 97)."""
    s = re.sub("[ ]", "", span)
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def written_mail(span: str) -> bool:
    """Whether words with 'at' and 'dot' are a mail address: marks set apart, a host, a domain-like end."""
    m = _WRITTEN.fullmatch(span)
    if m is None:
        return False
    last = m["last"].lower()
    if "[" in m["at"] + m["dot"] or "(" in m["at"] + m["dot"]:
        return last in _LAST or len(last) == 2
    return m["host"].lower() not in _WORDS and (last in _LAST or len(last) == 2 and last not in _WORDS)


def grouped_phone(span: str) -> bool | None:
    """Whether a number without plus has the groups and the digit count of a phone; None for digits in one run."""
    groups = re.findall("[0-9]+", span)
    if not 9 <= sum(map(len, groups)) <= 15 or _DATE.search(span):
        return False
    if len(groups) == 1:
        return None
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{3})+", span) or span.count("(") != span.count(")"):
        return False
    return len(groups) <= 6 and all(2 <= len(g) <= 5 for g in groups[1:]) and len(groups[0]) <= 5 and len(groups[-1]) >= 2


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Spans ``(start, kind, end)`` of the rules that pass and that fail their checks."""
    good, bad = [], []
    numbers = re.search("[0-9]", text) is not None
    for kind, pattern in BASE.items():
        if "@" in text if kind == "email" else numbers and (kind != "phone" or "+" in text):
            for m in pattern.finditer(text):
                if m.group(1) is None:
                    continue
                (good if _passes(kind, m.group()) else bad).append((m.start(), kind, m.end()))
    return good, bad


def proposals(text: str) -> list[tuple[int, str, int]]:
    """Spans of the loose generators; they may overlap."""
    out = []
    for kind, pattern in LOOSE.items():
        if kind == "number" and not re.search("[0-9]", text):
            continue
        if kind == "email_written" and "dot" not in text.lower():
            continue
        if kind == "account" and not re.search("[A-Z]{2}[0-9]{2}", text):
            continue
        for m in pattern.finditer(text):
            group = next((g for g in range(1, (m.lastindex or 0) + 1) if m.group(g) is not None), 0)
            out.append((m.start(group), kind, m.end(group)))
            if kind == "account":  # words after it may look like its last groups
                out += [(m.start(), kind, m.start() + k.start()) for k in re.finditer(" ", m.group()) if k.start() >= 15]
    return out


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    """Format and context of a span as numbers; its kind is not among them."""
    s = text[start:end]
    n = len(s)
    digits = sum(c.isdigit() for c in s)
    upper = sum(c.isupper() for c in s)
    lower = sum(c.islower() for c in s)
    groups = re.findall("[0-9]+", s)
    number = re.sub("[^0-9]", "", s)
    runs = len(re.findall(r"[0-9]+|[^\W\d_]+", s))
    left, right = text[max(0, start - 24) : start], text[end : end + 12]
    low = left.lower()
    return [
        n,
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        len(groups),
        max(map(len, groups), default=0),
        digits,
        runs,
        len(set(s)) / n,
        float("@" in s),
        s.count("."),
        s.count("-"),
        float(s[0] == "+"),
        float(12 <= len(number) <= 19 and number.isascii() and luhn(number)),
        float(any(ord(c) > 127 for c in s)),
        float(bool(re.search(r"[=:]\s*[\"']?$", left))),
        float(any(h in low for h in _HINTS[:9])),
        float(any(h in low for h in _HINTS[9:13])),
        float(left[-1:].isspace() or not left),
        float(right[:1].isspace() or not right),
        float(bool(re.match(r"[.,;]?(\s|$)", right))),
        float(s[0].isalpha() and s[2:4].isdigit() and iban(s)),
        float(written_mail(s)),
    ]


class Spans:
    """Stretches of a text, asked whether one of them meets or holds another."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], []
        for _, b in spans:
            self.reach.append(max(b, self.reach[-1] if self.reach else b))

    def _furthest(self, before: int) -> int:
        at = bisect_left(self.starts, before)
        return self.reach[at - 1] if at else -1

    def meets(self, a: int, b: int) -> bool:
        return self._furthest(b) > a

    def holds(self, a: int, b: int) -> bool:
        return self._furthest(a + 1) >= b


def _letters(r: Random, low: int, high: int) -> str:
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(low, high)))


def _digits(r: Random, shape: str) -> str:
    """``#`` as a digit, ``9`` as one that is not 0."""
    return "".join(r.choice(string.digits) if c == "#" else r.choice("123456789") if c == "9" else c for c in shape)


def made_span(r: Random) -> tuple[str, str, str, float]:
    """An invented piece of personal data or a look-alike: words before it, its text, its kind, its truth."""
    kind, true = r.choice(tuple(LOOSE)), r.random() < 0.5
    lead = r.choice(("", "", "and ", "see ", "the "))
    if kind == "email_written":
        at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT ")))
        user = _letters(r, 2, 7) + r.choice(("", ".", "_")) + _letters(r, 2, 5) + r.choice(("", _digits(r, "#"), _digits(r, "##")))
        if true:
            return r.choice((lead, "mail ", "write to ")), user + at + _letters(r, 3, 9) + dot + r.choice(sorted(_LAST)), kind, 1.0
        host = r.choice(sorted(_WORDS)) if r.random() < 0.6 else _letters(r, 3, 8)
        return lead, f"{_letters(r, 3, 8)} at {host} dot {_letters(r, 3, 9)}", kind, 0.0
    if kind == "number":
        if true:
            shape = r.choice(("(9##) ###-####", "9##-###-####", "9##.###.####", "0## ### ####", "0# ## ## ## ##", "9## ### ####", "(0##) #### ####", "0###-######"))
            return r.choice((lead, lead, "call ", "phone ", "tel. ")), _digits(r, shape), kind, 1.0
        shape = r.choice(("20##-0#-1# 1#:##", "1#.0#.20##", "9.###.###.###", "9## ### ###", "19##-20##", "9##,### ", "978-#-##-######-#", "99####", "1#.1#.# 2#", "9### 9### 9##"))
        return lead, _digits(r, shape).strip(), kind, 0.0
    if kind == "account":
        body = _digits(r, "#" * r.randint(12, 20))
        country = r.choice(("DE", "FR", "GB", "ES", "NL", "IT", "PL", "AT"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        text = country + f"{check if true else (check + r.randint(1, 90) - 2) % 97 + 2:02}" + body
        if not true and iban(text):
            text = country + "00" + body
        if r.random() < 0.5:
            text = " ".join(text[k : k + 4] for k in range(0, len(text), 4))
        return r.choice((lead, "IBAN ", "account ")), text, kind, float(true)
    if true:
        alphabet = r.choice(("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits))
        token = "".join(r.choice(alphabet) for _ in range(r.choice((r.randint(10, 20), r.randint(20, 40), 40))))
        before = r.choice(("token = ", "password=", "pwd: ", "api_key: ", "secret=")) if len(token) < 20 or r.random() < 0.7 else lead
        mark = r.choice(("", '"')) if before != lead else ""
        return before + mark, token, kind, 1.0
    mark = r.choice(("_", "-", "/"))
    words = [_letters(r, 3, 9) for _ in range(r.randint(3, 5))]
    return lead, r.choice((mark.join(words), "".join(w.title() for w in words), "".join(words) + _digits(r, "20##"))), kind, 0.0


def examples(text: str, made: int = MADE) -> list[tuple[list[float], float]]:
    """Training examples: spans put into the text, and spans of its own that fail their checks."""
    good, bad = base_spans(text)
    loose = proposals(text)
    labels = [_label(text, *x) for x in loose]
    known = Spans([(a, b) for a, _, b in good] + [(a, b) for (a, _, b), y in zip(loose, labels) if y is not False])
    failed = [*(x for x in bad if x[2] - x[0] > 2), *(x for x, y in zip(loose, labels) if y is False)]
    failed = [x for x in failed if not known.meets(x[0], x[2])]  # what fails as one kind may be of another
    r = Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    out = [(features(text, *x), 0.0) for x in (failed if len(failed) <= OWN else r.sample(failed, OWN))]
    for _ in range(made):
        lead, span, kind, truth = made_span(r)
        at = r.randint(0, len(text))
        at = next((k for k in range(at, max(at - 60, 0), -1) if text[k - 1].isspace()), 0)
        before, after = text[max(0, at - 60) : at], text[at : at + 60]
        whole = f"{before}{lead}{span} {after}"
        start = len(before) + len(lead)
        for a, k, b in proposals(whole):
            if k == kind and (truth == 0.0 and start <= a and b <= start + len(span) or (a, b) == (start, start + len(span))):
                out.append((features(whole, a, k, b), truth))
    return out


def _label(text: str, a: int, kind: str, b: int) -> bool | None:
    """Whether a proposal passes the check of its kind; None where that is open."""
    s = text[a:b]
    if kind == "email_written":
        return written_mail(s)
    if kind == "account":
        return iban(s)
    if kind == "number":
        return grouped_phone(s)
    return bool(re.search(r"[=:]\s*[\"']?$", text[max(0, a - 24) : a])) or _mixed(s)


def _mixed(s: str) -> bool:
    """Whether a run looks drawn at random: digits spread among letters of one case or both."""
    return len(re.findall("[0-9]+", s)) >= 2 and any(c.isalpha() for c in s)


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple | None:
    """Trees, calibration and threshold from a bounded sample; None without examples of both kinds.

    The examples of ``SAMPLE_DOCS`` documents, picked by the hash of the id, are labelled
    as ``examples`` says. All else, the search and the threshold's use, covers all documents.
    """
    rows = bounded_sample(docs.select(id_col, text_col).where(F.col(text_col).isNotNull()), (id_col, text_col), SAMPLE_DOCS, seed=7)

    def make():
        def run(r: dict) -> list:
            found = [e for t in r[text_col] for e in examples(t)]
            return [[f for f, _ in found], [y for _, y in found], [hash(tuple(f)) & 0x7FFFFFFF for f, _ in found]]

        return run

    pdf = map_rows(rows, "f array<double>, y double, h long", make).orderBy("h", "y", "f").limit(SAMPLE_SPANS).toPandas()
    if pdf.empty or pdf["y"].nunique() < 2:
        return None
    x, y = np.stack(pdf["f"].to_numpy()), pdf["y"].to_numpy()
    held = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), bool)
    trees = BoostedTrees(80).fit(x[~held], y[~held])
    test = held if held.any() else ~held
    score = trees.decision(x[test])
    calibration = Logistic().fit(score[:, None], y[test], l2=0.01)
    p = calibration.predict(score[:, None])
    threshold = lowest_threshold(p, y[test])
    if threshold <= 1:  # halfway to the next candidate below
        threshold = (threshold + p[p < threshold].max(initial=0.0)) / 2
    return trees, calibration, max(float(threshold), 0.5)


def lowest_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest of all thresholds that keep the precision, also below ones that do not; 1.1 if none does."""
    order = np.argsort(-p, kind="stable")
    p, share = p[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(p[1:] != p[:-1], True)
    return float(p[ends & (share >= PRECISION)].min(initial=1.1))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in whole texts.

    Returns, for every row, ``doc_id``, the columns in ``keep``, the text
    (``text``), and ``spans``: structs of kind, start, end (code points, end
    exclusive), score and base, sorted by start and kind. A null text counts as
    empty and has none. Rows are independent. An added span that lies within a
    base span is left out; others may overlap. Very long texts are searched whole,
    in linear time. Repeated and null ids give a row each; an empty table gives
    none. Other columns are ignored; ``keep`` must not name ``spans``.
    """
    keep = tuple(c for c in keep if c not in (id_col, text_col))
    model = learn(docs, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = (
        f"`{id_col}` {kind}{more}, `{text_col}` string, "
        "spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
    )

    def make():
        def run(r: dict) -> list:
            return [r[id_col], *(r[c] for c in keep), r[text_col], _spans(r[text_col], shared.value)]

        return run

    return map_rows(docs.select(id_col, *keep, text_col), schema, make)


def _spans(texts: list[str | None], model: tuple | None) -> list[list[dict]]:
    out, asked, where = [], [], []
    for k, text in enumerate(texts):
        good = base_spans(text)[0] if text else []
        out.append([(a, kind, b, 1.0, True) for a, kind, b in good])
        if text and model:
            covered = Spans([(a, b) for a, _, b in good])
            for a, kind, b in proposals(text):
                if not covered.holds(a, b):
                    asked.append(features(text, a, kind, b))
                    where.append((k, a, kind, b))
    if asked:
        trees, calibration, threshold = model
        p = calibration.predict(trees.decision(np.array(asked))[:, None])
        for (k, a, kind, b), q in zip(where, p):
            if q >= threshold:
                out[k].append((a, kind, b, float(q), False))
    return [
        [
            dict(zip(("start", "kind", "end", "score", "base"), s))
            for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
        ]
        for spans in out
    ]


def redact(found: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """Texts with each stretch of overlapping spans replaced by the kind of its first span."""
    columns = [c for c in found.columns if c not in ("spans", text_col, out_col)]
    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        def run(r: dict) -> list:
            return [*(r[c] for c in columns), [_redacted(t, s) for t, s in zip(r[text_col], r["spans"])]]

        return run

    return map_rows(found, f"{schema}, `{out_col}` string", make)


def _redacted(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        first, end = spans[k], spans[k]["end"]
        while k < len(spans) and spans[k]["start"] < end:
            end = max(end, spans[k]["end"])
            k += 1
        out += [text[at : first["start"]], f"<{first['kind'].upper()}>"]
        at = end
    return "".join(out) + text[at:]

"""Personal data, natively: generators propose spans, boosted trees score them, a calibrated threshold selects.

The main path is DataFrame functions alone: regular expressions give match strings and the gaps between them, running sums
of their lengths give positions in code points, and the trees are nested conditions over format and context features. Nothing
is exploded or shuffled, so hot sources and long texts stay within their own row.

The trees are fitted on the driver to texts from fixed templates (positive and look-alike negative forms), with features
computed by the same expressions. Templates are split, not their instances: the trees see the first share, every kind's threshold is the lowest score
whose precision on the second is PRECISION, and `accuracy` measures precision and recall on the third, whose wordings and formats neither has seen.

Nulls: a null text is empty. Texts without spans give zero counts, the digest of the empty string and an empty span list.
Rows with equal doc_id stay separate; extra columns are ignored. Added spans never overlap base spans; where two added
candidates overlap, the higher score stays (ties: the earlier, then the longer).
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm import boosting
from skillcube.llm.common import read_table

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "handle", "iban", "birth", "device", "document")
PRECISION = 0.99
CONTEXT = 32

# The patterns start only where a match can start (a run's first character, or where the last match ended) and do not
# backtrack into runs, so they are linear in the text and find the same leftmost matches as the plain forms.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_VALID = rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$"
# High-recall generators.
_NUMBER = r"(?<![0-9A-Za-z+])[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9])"
_HANDLE = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[({ ](?:at|AT|@)[\])} ] ?[A-Za-z0-9-]{2,40}(?: ?[\[({ ](?:dot|DOT|\.)[\])} ] ?[A-Za-z]{2,12}){1,3}"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
_BIRTH = r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2})(?![0-9])"
_DEVICE = r"(?<![0-9A-Za-z:.-])(?:[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}|(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:-])"
_DOCUMENT = r"(?<![A-Za-z0-9])(?:[A-Z]{1,3}[0-9]{6,9}[A-Z]?|[0-9]{8}[A-Z])(?![A-Za-z0-9])"
_BLOCK = 64


def matches(text: str, pattern: str) -> Column:
    """array<struct<start,stop,match,left,right>> of the leftmost matches, which must have a length. Positions are code points.

    text: the name of a string column. Positions are sums of gap and match lengths: running sums of blocks first, then within a block, so many
    matches stay cheap. Written as SQL because building it from columns takes longer than running it.
    """
    total = lambda xs: f"aggregate({xs}, 0, (u, x) -> u + x)"
    block = f"CAST(i DIV {_BLOCK} AS INT)"
    start = f"before[{block}] + {total(f'slice(steps, {block} * {_BLOCK} + 1, i % {_BLOCK})')} + length(a.gaps[i])"
    span = f"named_struct('start', start, 'stop', start + length(m), 'match', m, 'left', right(a.gaps[i], {CONTEXT}), 'right', substring(a.gaps[i + 1], 1, 12))"
    placed = f"transform(slice(a.found, 1, size(a.found) - 1), (m, i) -> transform(array({start}), start -> {span})[0])"
    blocks = f"transform(sequence(0, CAST((size(steps) - 1) DIV {_BLOCK} AS INT)), b -> {total(f'slice(steps, b * {_BLOCK} + 1, {_BLOCK})')})"
    before = f"aggregate({blocks}, array(0), (u, x) -> concat(u, array(element_at(u, -1) + x)))"
    steps = "zip_with(a.gaps, a.found, (g, m) -> length(g) + length(m))"
    found = f"named_struct('gaps', split(`{text}`, r'{pattern}', -1), 'found', concat(regexp_extract_all(`{text}`, r'{pattern}', 0), array('')))"
    return F.expr(f"transform(array({found}), a -> transform(array({steps}), steps -> transform(array({before}), before -> {placed})[0])[0])[0]")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _iban_ok(s: Column) -> Column:
    """Remainder 1 modulo 97 of the rearranged number."""
    flat = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _kept(found: Column, kind: int, passes) -> Column:
    return F.transform(F.filter(found, passes), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


_NONE = "array<struct<start:int,kind:int,stop:int>>"
_NO_MATCH = "array<struct<start:int,stop:int,match:string,left:string,right:string>>"


def base_parts(text: str) -> list[Column]:
    """For each base kind array<struct<start,kind,stop>> in text order (kind: its place in BASE_KINDS). text: the name of a column without nulls."""
    none = F.array().cast(_NONE)
    n = lambda x: F.length(_digits(x["match"]))
    t = F.col(text)
    return [
        F.when(F.contains(t, F.lit("@")), _kept(matches(text, _EMAIL), 0, lambda x: F.lit(True))).otherwise(none),
        F.when(t.rlike(r"[0-9]\.[0-9]"), _kept(matches(text, _IP), 1, lambda x: x["match"].rlike(_IP_VALID))).otherwise(none),
        F.when(t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), _kept(matches(text, _CARD), 2, lambda x: n(x).between(14, 19) & luhn(_digits(x["match"])))).otherwise(none),
        F.when(F.contains(t, F.lit("+")) & t.rlike("[0-9]"), _kept(matches(text, _PHONE), 3, lambda x: n(x).between(10, 15))).otherwise(none),
    ]


def base_spans(text: str) -> Column:
    """array<struct<start,kind,stop>>, sorted, of the base kinds."""
    return F.array_sort(F.concat(*base_parts(text)))


def _count_where(xs: str, before) -> str:
    """SQL: how many elements at the front of an array satisfy `before`, which holds for a front part of it: by bisection."""
    mid = "CAST((s.lo + s.hi) DIV 2 AS INT)"
    halves = f"IF({before(f'{xs}[{mid}]')}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid}))"
    steps = f"sequence(1, greatest(1, CAST(ceil(log2(size({xs}) + 1.0D)) AS INT)))"
    return f"aggregate({steps}, named_struct('lo', 0, 'hi', size({xs})), (s, q) -> IF(s.lo < s.hi, {halves}, s), s -> s.lo)"


def _hit(xs: str) -> str:
    """SQL: whether the span c overlaps one of xs, which are in order and do not overlap each other."""
    return f"IF(size({xs}) = 0, false, transform(array({_count_where(xs, lambda x: f'{x}.start < c.stop')}), n -> IF(n > 0, {xs}[n - 1].stop > c.start, false))[0])"


def _beaten(xs: str) -> str:
    """SQL: whether one of xs overlaps the candidate c and ranks before it."""
    first, last = _count_where(xs, lambda x: f"{x}.stop <= c.start"), _count_where(xs, lambda x: f"{x}.start < c.stop")
    ranks = "struct(o.score, -o.start, o.stop, o.kind) > struct(c.score, -c.start, c.stop, c.kind)"
    return f"IF(size({xs}) = 0, false, transform(array(struct({first} AS a, {last} AS z)), r -> exists(slice({xs}, r.a + 1, greatest(r.z - r.a, 0)), o -> {ranks}))[0])"


def _context(words: str) -> str:
    """One of the words, and at most two more before the candidate."""
    return rf"(?i)(?<![A-Za-z])(?:{words})[^0-9A-Za-z]{{0,4}}(?:\w{{0,8}}[^0-9A-Za-z]{{1,3}}){{0,2}}$"


_PHONE_WORDS = _context(r"phone|tel|telefon|teléfono|téléphone|call|mobile|cell|fax|whatsapp|contact|handy|móvil")
_ID_WORDS = _context(r"ssn|social security|tax id|national id|passport|nif|dni|steuer-?id|insee")
_BANK_WORDS = _context(r"iban|account|konto|cuenta|compte|bank")
_MAIL_WORDS = _context(r"e-?mail|mail|write|contact|reach|correo|courriel")
_BIRTH_WORDS = _context(r"born|birth|birthday|dob|d\.o\.b\.?|geboren|geb\.|nacid[oa]|naissance|née")
_DEVICE_WORDS = _context(r"mac|ipv6|ip|address|host|device|client|router|interface|hwaddr|ether|inet6")
_PAPER_WORDS = _context(r"passport|pass|licen[cs]e|permit|visa|ausweis|nif|nie|dni|pasaporte|passeport|identity|id card")
_OTHER_WORDS = r"(?i)(?:(?<![A-Za-z])(?:order|invoice|ref|version|isbn|issn|page|pages|serial|tracking|item|ticket|part|model|no|id|date|on|in|since|updated|ratio|code|v)|[$€£#=])[^0-9A-Za-z]{0,4}$"


def _features(x: Column, kind: int) -> list[Column]:
    """Format and context of one candidate, as doubles."""
    m, left, right = x["match"], x["left"], x["right"]
    return [c.cast("double") for c in (
        F.lit(kind), F.length(_digits(m)), F.length(m),
        m.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), m.rlike("^0[0-9]{1,4}[ /-][0-9 -]{5,}$"),
        m.rlike(r"^(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ]"), m.rlike(r"^[0-9]+(?:[.][0-9]+){1,9}$"), m.rlike("^[0-9]+$"),
        F.length(F.regexp_replace(m, r"[^ ().\-/]", "")), luhn(_digits(m)), _iban_ok(m) if kind == 2 else F.lit(False),
        left.rlike(_PHONE_WORDS), left.rlike(_ID_WORDS), left.rlike(_BANK_WORDS), left.rlike(_MAIL_WORDS), left.rlike(_OTHER_WORDS),
        m.rlike(r"[\[({](?:at|AT|@)[\])}]"), m.rlike(r"[\[({ ](?:dot|DOT)[\])} ]"), m.rlike(r"(?i)[^A-Za-z](?:com|org|net|edu|gov|de|fr|es|uk|io|eu)$"),
        left.rlike(_BIRTH_WORDS), left.rlike(_DEVICE_WORDS), left.rlike(_PAPER_WORDS), m.rlike("^[0-9A-Fa-f]{2}[:-]"), m.rlike("[A-Fa-f]"), m.rlike("::"), m.rlike("[:-].*[:-].*[:-].*[:-].*[:-]"),
        right.rlike("^[A-Za-z%°]"), right.rlike(r"^[.,;:)]?(?:\s|$)"),
    )]


def _proposed(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), F.array(*_features(x, kind)).alias("f")))


_CANDIDATES = "array<struct<start:int,stop:int,kind:int,f:array<double>>>"


def candidate_parts(text: str) -> list[Column]:
    """For each added kind array<struct<start,stop,kind,f>> of what its generator proposes, in text order; f: the features."""
    none = F.array().cast(_CANDIDATES)
    t = F.col(text)
    digit = t.rlike("[0-9]{2}")
    guards = (
        (_NUMBER, t.rlike(r"[0-9](?:[ ().\-/]{0,2}[0-9]){6}")), (_HANDLE, t.rlike(r"(?i)[\[({ ](?:at|@)[\])} ]") & t.rlike(r"(?i)[\[({ ](?:dot|\.)[\])} ]")), (_IBAN, t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
        (_BIRTH, digit & t.rlike(r"[0-9][./-][0-9]{1,2}[./-][0-9]")), (_DEVICE, t.rlike("[0-9A-Fa-f][:-]{1,2}[0-9A-Fa-f]{1,4}[:-]")), (_DOCUMENT, t.rlike("[A-Z][0-9]{6}|[0-9]{8}[A-Z]")),
    )
    return [F.when(guard, _proposed(matches(text, pattern), k)).otherwise(none) for k, (pattern, guard) in enumerate(guards)]


def candidates(text: str) -> Column:
    """All that the generators propose, overlapping or not."""
    return F.concat(*candidate_parts(text))


def tree_score(model: boosting.Trees, f: str) -> str:
    """Log-odds as one SQL expression over the feature array f."""

    def node(t: int, i: int) -> str:
        if i >= 2**model.depth - 1:
            return f"{float(model.value[t, i - (2**model.depth - 1)])!r}D"
        if np.isinf(model.threshold[t, i]):
            return node(t, 2 * i + 1)
        return f"IF({f}[{int(model.feature[t, i])}] > {float(model.threshold[t, i])!r}D, {node(t, 2 * i + 2)}, {node(t, 2 * i + 1)})"

    return " + ".join([f"{float(model.base)!r}D", *(node(t, 0) for t in range(len(model.feature)))])


def _templates(r: random.Random) -> list[tuple[int, int, int, object]]:
    """(kind, share, 1 if personal, maker): shares 0, 1 and 2 are for fitting, thresholds and measuring; every wording and format is in one share only."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8)))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    up = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTXYZ") for _ in range(k))
    day = lambda sep: f"{r.randint(1, 28):02d}{sep}{r.randint(1, 12):02d}{sep}{r.randint(1930, 2010)}"

    def iban(land: str, valid: bool, spaced: bool) -> str:
        body = d(18)
        rest = int("".join(str(int(c, 36)) for c in body + land + "00"))
        s = f"{land}{98 - rest % 97 if valid else (98 - rest % 97 + r.randint(1, 60)) % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if spaced else s

    def at(a: str, b: str) -> str:
        return f"{w()}.{w()}{a}{w()}{b}{r.choice(['com', 'org', 'net', 'de'])}"

    out: list[tuple[int, int, int, object]] = []

    def add(kind: int, y: int, *shares) -> None:
        out.extend((kind, k, y, make) for k, makers in enumerate(shares) for make in makers)

    add(0, 1,
        [lambda: f"phone: ({d(3)}) {d(3)}-{d(4)}", lambda: f"call me at 0{d(2)} {d(4)} {d(4)}", lambda: f"SSN {d(3)}-{d(2)}-{d(4)}", lambda: f"mobile 0{d(3)}/{d(7)}", lambda: f"cell {d(3)} {d(3)} {d(4)}"],
        [lambda: f"tel. {d(3)}-{d(3)}-{d(4)}", lambda: f"ssn: {d(3)}-{d(2)}-{d(4)}", lambda: f"fax: ({d(3)}) {d(3)} {d(4)}", lambda: f"handy 0{d(4)} {d(6)}"],
        [lambda: f"WhatsApp {d(3)}.{d(3)}.{d(4)}", lambda: f"social security number {d(3)}-{d(2)}-{d(4)}", lambda: f"téléphone 0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"contact: 0{d(3)}-{d(6)}"])
    add(0, 0,
        [lambda: f"order {d(r.randint(7, 18))}", lambda: f"{w()} {d(r.choice([14, 15, 16, 16, 17, 19]))} {w()}", lambda: f"{w()} {d(3)} {d(3)} {d(3)}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"pages {d(4)}-{d(4)}", lambda: f"version {d(2)}.{d(3)}.{d(4)}.{d(2)}", lambda: f"{w()} {d(3)}-{d(3)}-{d(4)} {w()}"],
        [lambda: f"invoice no {d(r.randint(7, 15))}", lambda: f"{w()}, {d(r.choice([13, 16, 18]))} {w()}", lambda: f"{w()} {d(4)} {d(4)} {d(4)} {d(4)} {w()}", lambda: f"ratio {d(4)}.{d(6)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(4)}"],
        [lambda: f"tracking {d(r.randint(9, 18))}", lambda: f"{w()}. {d(r.choice([14, 16, 19]))}, {w()}", lambda: f"{w()} {d(5)} {d(5)} {w()}", lambda: f"serial {d(4)}-{d(4)}-{d(3)}", lambda: f"{d(4)}.{d(7)} m"])
    add(1, 1,
        [lambda: f"email {at(' at ', ' dot ')}", lambda: f"write to {at(' [at] ', ' [dot] ')}", lambda: f"{w()} {at('(at)', '(dot)')}"],
        [lambda: f"contact: {at(' (at) ', ' (dot) ')}", lambda: f"mail {at('[at]', '[dot]')}"],
        [lambda: f"reach me: {at(' {at} ', ' {dot} ')}", lambda: f"correo {at(' at ', ' dot ')}", lambda: f"{w()} {at(' [AT] ', ' [DOT] ')}"])
    add(1, 0,
        [lambda: f"{w()} {w()} at {w()} dot {w()}", lambda: f"{w()} at {w()} . {w()} {w()}"],
        [lambda: f"the {w()} at {w()} . The {w()}", lambda: f"{w()} looked at {w()} dot {w()}"],
        [lambda: f"at {w()} at {w()} . {w()}", lambda: f"{w()} met at {w()} dot {w()} {w()}"])
    add(2, 1,
        [lambda: f"IBAN {iban('DE', True, True)}", lambda: f"{w()} {iban('FR', True, False)}", lambda: f"pay to {iban('GB', True, False)}"],
        [lambda: f"account: {iban('ES', True, False)}", lambda: f"Konto {iban('NL', True, True)}"],
        [lambda: f"cuenta {iban('IT', True, True)}", lambda: f"{w()}, {iban('AT', True, False)}"])
    add(2, 0,
        [lambda: f"code {iban('DE', False, False)}", lambda: f"id {iban('FR', False, True)}", lambda: f"{w()} {iban('PL', False, r.random() < 0.5)} {w()}", lambda: f"IBAN {iban('BE', False, r.random() < 0.5)}"],
        [lambda: f"{w()} {iban('ES', False, False)}", lambda: f"part {up(2)}{d(2)}{up(4)}{d(8)}"],
        [lambda: f"{w()}, {iban('IT', False, True)}", lambda: f"model {up(2)}{d(10)}"])
    add(3, 1,
        [lambda: f"born {day('.')}", lambda: f"date of birth: {day('/')}", lambda: f"geboren am {day('.')}"],
        [lambda: f"DOB {day('/')}", lambda: f"birthday {day('-')}"],
        [lambda: f"nacido el {day('/')}", lambda: f"d.o.b. {r.randint(1930, 2010)}-{d(2)}-{d(2)}", lambda: f"birth: {day('.')}"])
    add(3, 0,
        [lambda: f"on {day('.')}", lambda: f"{w()} {day('/')} {w()}", lambda: f"since {r.randint(1990, 2024)}-{d(2)}-{d(2)}"],
        [lambda: f"date {day('-')}", lambda: f"{w()}, {day('.')}, {w()}"],
        [lambda: f"updated {day('/')}", lambda: f"{w()} {r.randint(1990, 2024)}/{d(2)}/{d(2)}"])
    add(4, 1,
        [lambda: "mac " + ":".join(h(2) for _ in range(6)), lambda: "host " + ":".join(h(4) for _ in range(8)), lambda: f"address fe80::{h(4)}:{h(4)}:{h(4)}", lambda: f"{w()} " + "-".join(h(2).upper() for _ in range(6))],
        [lambda: "hwaddr " + ":".join(h(2) for _ in range(6)), lambda: f"{w()} " + ":".join(h(4) for _ in range(8)), lambda: f"ipv6 2001:{h(3)}::{h(4)}"],
        [lambda: "device " + "-".join(h(2) for _ in range(6)), lambda: f"inet6 fe80::{h(4)}:{h(4)}", lambda: "router " + ":".join(h(2).upper() for _ in range(6))])
    add(4, 0,
        [lambda: f"at {d(2)}:{d(2)}:{d(2)}", lambda: f"{w()} {d(1)}:{d(2)}:{d(2)}:{d(2)}"],
        [lambda: f"took {d(2)}:{d(2)}:{d(2)}", lambda: f"ratio {d(1)}:{d(1)}:{d(1)}"],
        [lambda: f"{w()}, {d(2)}:{d(2)}:{d(2)} {w()}", lambda: f"verse {d(1)}:{d(2)}:{d(1)}"])
    add(5, 1,
        [lambda: f"passport {up(1)}{d(8)}", lambda: f"passport no {up(2)}{d(7)}", lambda: f"driving licence {up(2)}{d(6)}", lambda: f"NIF {d(8)}{up(1)}"],
        [lambda: f"visa {up(1)}{d(7)}", lambda: f"dni {d(8)}{up(1)}"],
        [lambda: f"permit {up(2)}{d(7)}", lambda: f"Ausweis {up(1)}{d(8)}", lambda: f"pasaporte: {up(3)}{d(6)}"])
    add(5, 0,
        [lambda: f"part {up(2)}{d(6)}", lambda: f"{w()} {up(1)}{d(7)} {w()}", lambda: f"model {d(8)}{up(1)}"],
        [lambda: f"item {up(3)}{d(6)}", lambda: f"{w()}, {d(8)}{up(1)}"],
        [lambda: f"ref {up(2)}{d(7)}", lambda: f"{w()} {up(1)}{d(8)}. {w()}"])
    return out


def template_texts(seed: int = 7, each: int = 40) -> list[tuple[int, str, int, int]]:
    """(share, text, kind, 1 if personal): `each` texts of every template."""
    r = random.Random(seed)
    w = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8)))
    out = []
    for kind, share, y, make in _templates(r):
        for _ in range(each):
            tail = f"{r.choice([' ', '. ', ', '])}{w()}" if r.random() < 0.7 else ""
            out.append((share, f"{w()} {w()} {make()}{tail}", kind, y))
    return out


_FITTED: dict[str, tuple[boosting.Trees, list[float], dict]] = {}


def fitted(spark: SparkSession, each: int = 40) -> tuple[boosting.Trees, list[float], dict]:
    """Trees, every kind's threshold (log-odds) and the accuracy by kind, fitted once per application to `each` texts of every template."""
    key = f"{spark.sparkContext.applicationId}-{each}"
    if key not in _FITTED:
        texts = spark.createDataFrame([(n, *t) for n, t in enumerate(template_texts(each=each))], "n int, share int, text string, kind int, y int")
        # of a text's candidates those of its template's kind are judged by the template; others are no personal data
        rows = texts.select("n", "share", "kind", "y", F.explode(candidates("text")).alias("c")).select("n", "share", (F.col("y") * (F.col("kind") == F.col("c.kind")).cast("int")).alias("y"), "c.kind", "c.f").collect()
        rows.sort(key=lambda x: (x.n, x.kind, x.f))
        x, y, share, kind = np.array([a.f for a in rows]), np.array([a.y for a in rows], float), np.array([a.share for a in rows]), np.array([a.kind for a in rows])
        model = boosting.fit(x[share == 0], y[share == 0], trees=40, depth=3, rate=0.3, least=2.0)
        margin = model.margin(x)
        thresholds, accuracy = [], {}
        for k, name in enumerate(ADDED_KINDS):
            mine = (kind == k) & (share == 1)
            order = np.argsort(-margin[mine], kind="stable")
            precision = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
            good = np.flatnonzero(precision >= PRECISION)
            # half way to the next candidate below, but never below even odds
            lowest = margin[mine][order]
            cut = float((lowest[good[-1]] + lowest[min(good[-1] + 1, len(lowest) - 1)]) / 2) if len(good) else np.inf
            thresholds.append(max(0.0, cut))
            test = (kind == k) & (share == 2)
            taken = test & (margin >= thresholds[-1])
            accuracy[name] = (float(y[taken].mean()) if taken.any() else 1.0, float(y[taken].sum() / max(1, sum(a[0] == 2 and a[2] == k and a[3] for a in template_texts(each=each)))))
        _FITTED[key] = model, thresholds, accuracy
    return _FITTED[key]


def accuracy(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """(precision, recall) of every added kind on the templates that neither fitting nor thresholds have seen."""
    return fitted(spark)[2]


def find_spans(docs: DataFrame, base: str = "base", added: str = "added") -> DataFrame:
    """docs with base (sorted base spans) and added (selected further spans), arrays of struct<start,kind,stop>.

    A column of docs that has one of these two names is kept as <its name>_input.
    The kind of an added span is its place in BASE_KINDS + ADDED_KINDS. Spans of one kind are in order and apart, so overlaps are found by bisection.
    """
    model, thresholds, _ = fitted(docs.sparkSession)
    kinds, more = range(len(BASE_KINDS)), range(len(ADDED_KINDS))
    rows = docs.withColumnsRenamed({c: f"{c}_input" for c in docs.columns if c.lower() in (base, added)}).withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({f"__b{k}": c for k, c in enumerate(base_parts("__text"))} | {f"__c{k}": c for k, c in enumerate(candidate_parts("__text"))})
    # candidates that touch no base span
    touched = " OR ".join(_hit(f"__b{k}") for k in kinds)
    free = [f"IF(size(__c{k}) = 0, CAST(array() AS {_CANDIDATES}), filter(__c{k}, c -> NOT ({touched})))" for k in more]
    rows = rows.withColumn("__f", F.expr(f"concat({', '.join(free)})"))
    rows = rows.withColumn("__t", F.expr(f"transform(__f, c -> struct({tree_score(model, 'c.f')} AS score, c.start AS start, c.stop AS stop, c.kind AS kind))"))
    rows = rows.withColumns({f"__s{k}": F.expr(f"filter(__t, c -> c.kind = {k} AND c.score >= {thresholds[k]!r}D)" if np.isfinite(thresholds[k]) else "slice(__t, 1, 0)") for k in more})

    def best(k: int) -> Column:
        beaten = " OR ".join(_beaten(f"__s{j}") for j in more if j != k)
        return F.expr(f"transform(filter(__s{k}, c -> NOT ({beaten})), c -> struct(c.start AS start, {k + len(BASE_KINDS)} AS kind, c.stop AS stop))")

    selected = [F.when(F.size(f"__s{k}") > 0, best(k)).otherwise(F.array().cast(_NONE)) for k in more]
    return rows.withColumns({base: F.array_sort(F.concat(*(F.col(f"__b{k}") for k in kinds))), added: F.array_sort(F.concat(*selected))}).drop("__text", "__f", "__t", *(f"__{x}{k}" for x in "bcs" for k in more))


def shown(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in BASE_KINDS + ADDED_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans become one. All other columns stay, whatever their names."""
    spans = F.array_sort(F.concat("__base", "__added"))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.concat(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.concat(a["out"], gap).alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))

    done = F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return find_spans(docs, "__base", "__added").withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text"))).select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"))

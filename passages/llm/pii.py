"""PII by weak supervision.

1. Where the text is read, wide patterns propose candidate spans and eight labelers (strict pattern, checksum or
   range, gazetteer, context for, context against, shape, boundaries, people nearby) vote yes, no or nothing on each. The gazetteers are country
   codes of mail domains and mail providers, IBAN countries with their lengths, card issuers' ranges with theirs, dialling codes, reserved networks, prefixes of
   access tokens, kinds of streets, and given names and forms of address. Contexts are the 32 characters on either side.
2. Spans are counted by signature (kind, votes, features). Votes and features have a few values each, so there are
   a bounded number of signatures however large the corpus is; only these counts reach the driver.
3. Expectation-maximisation over the counts estimates each labeler's reliability for each kind, and each kind's rate. What arithmetic settles isn't
   estimated: a real card or IBAN passes its checksum, and a chance number does so one time in 10 or 97.
4. A logistic span classifier is trained on the features with the posteriors as soft labels, over all spans.
5. Spans of probability >= ``least`` are reported (``find``) or replaced by ``[KIND]`` (``redact``, which reads the
   texts a second time rather than shuffling them).

Defined results: null and empty texts have no spans (and ``redact`` leaves null null); places count Unicode code points; spans of a
document never overlap; repeated rows are reported again, and rows of one id each by itself; a null id is reported as such; texts of any length are read whole, in time linear in their length; of patterns that match at
one place the first in the order of ``KINDS`` wins; an empty table gives an empty result; ``redact`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from passages.llm.storage import checkpoint, text_batches
from passages.llm.text import buffers, filled

LEAST = 0.5
KINDS = ("email", "secret", "iban", "ssn", "card", "ip", "address", "phone", "number")
_WIDE = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)++)"
    r"|(?P<secret>(?<![\w+/-])(?=[A-Za-z_+/-]*\d)(?=[\d_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<address>(?<![\w.,])\d{1,5}[a-z]?,? (?:(?:[A-Z][\w'-]{1,24}|\d{1,3}(?:st|nd|rd|th)) ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)\b|(?<![\w.,])\d{1,4},? (?:rue|avenue|boulevard|impasse|quai|calle|avenida|plaza|paseo) (?:[a-z]{1,4} ){0,2}[A-Z][\w'-]{1,24}|(?<!\w)[A-ZÄÖÜ][a-zäöüß-]{1,24}(?:straße|strasse|gasse|platz|weg|allee) \d{1,4}\b)"
    r"|(?P<phone>(?<![\w.+(])(?<!\d[ .-])(?=(?:[+(). -]{0,3}\d){7})(?!(?:[+(). -]{0,3}\d){16})(?:\+\d{1,3}[ .-]?(?:\(?\d\)?[ .-]?)?|\d[ .-])?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]{0,2}(?:\(\d{2,4}\)|(?<!\d)\d{2,4}))+(?![\w]|[ .-]\d)"
    r"|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<!\w)\+\d{7,15}(?!\w))"
    r"|(?P<number>(?<![\w.,])\d{5,12}(?![\w]))"
)
_STRICT = {
    "email": re.compile(r"[\w][\w.+%-]{0,63}@(?:[\w-]{1,63}\.)+[A-Za-z]{2,24}"),
    "secret": re.compile(r"[0-9a-fA-F]{32,128}|[A-Za-z0-9_+/-]{20,128}={0,2}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,38}"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"),
    "card": re.compile(r"\d{16}|\d{15}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}"),
    "phone": re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|(?:\+\d{1,3}[ .-]?|0)\(?[1-9]\)?(?:[ .-]?\d\d){4}|(?:\+34[ .-]?)?[6-9]\d{1,2}(?:[ .-]\d{2,3}){2,3}|[2-9]\d\d-\d{4}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
}
_TLDS = frozenset(
    "com org net edu gov mil int info biz name io dev app ac ad ae af ag ai al am ao aq ar as at au aw az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly "
    "ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sx sy sz "
    "tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
_PROVIDERS = frozenset("gmail.com googlemail.com outlook.com hotmail.com live.com yahoo.com icloud.com me.com aol.com proton.me protonmail.com gmx.de gmx.net web.de t-online.de orange.fr free.fr laposte.net wanadoo.fr mail.ru yandex.ru qq.com 163.com".split())
_DIAL = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 "
    "240 241 242 243 244 245 246 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 "
    "420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 850 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 "
    "970 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
_IBAN = {
    x[:2]: int(x[2:])
    for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20".split()
}
#: Card issuers: first and last prefix, lengths.
_ISSUERS = (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14, 16)), ("62", "62", (16, 17, 18, 19)), ("50", "50", tuple(range(13, 20))), ("56", "58", tuple(range(13, 20))))
_NAMES = re.compile(
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Monsieur|Madame|Herr|Frau|Señora?|Sra?|Don|Doña|James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|"
    r"Christopher|Lisa|Daniel|Nancy|Matthew|Anthony|Andrew|Emily|Joshua|Donna|Kevin|Michelle|Brian|Laura|George|Anna|Peter|Hans|Klaus|Jürgen|Wolfgang|Andreas|Stefan|Ursula|Monika|Petra|Sabine|Katrin|Heike|Jean|Pierre|Michel|André|Philippe|"
    r"Nathalie|Isabelle|Sylvie|Catherine|Françoise|Sophie|Camille|José|Juan|Antonio|Manuel|Francisco|Carlos|Javier|María|Carmen|Ana|Isabel|Lucía|Marta|Pablo|Luis|Jorge|Sergio)\b"
)
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|reach|@", re.I),
    "secret": re.compile(r"token|key|secret|passw|auth|bearer|credential|[=:]\s*[\"']?$", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|cell|contact", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|login|from", re.I),
    "address": re.compile(r"address|lives?\b|resid|adresse|anschrift|domicil|\bat\b|wohn|vive", re.I),
    "number": re.compile(r"account|passport|licen[cs]e no|patient|\bid\b", re.I),
}
_AGAINST = re.compile(r"isbn|issn|doi|version|\bv\.?\s?$|page|order|invoice|figure|fig\.|pp\.|commit|sha\d*|md5|\bno\.\s?$|§", re.I)
_DATE = re.compile(r"(?:19|20)\d\d([ .-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([ .-])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d|(?:19|20)\d\d[ -]+(?:19|20)\d\d")
_NEAR = 32


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) % 10 == -sum(x * 2 - 9 * (x > 4) for x in d[1::2]) % 10


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _valid(kind: str, s: str, digits: str) -> str:
    """The checksum or range labeler."""
    if kind == "card":
        good = _luhn(digits)
    elif kind == "iban":
        good = _mod97(s)
    elif kind == "ip":
        good = all(int(x) < 256 for x in s.split("."))
    elif kind == "email":
        good = ".." not in s and s.rpartition(".")[2].isalpha()
    elif kind == "phone":
        good = 7 <= len(digits) <= 15 and not _DATE.fullmatch(s)
    elif kind == "secret":
        good = len(set(s)) >= 10 and sum(c.isdigit() for c in s) >= 3
    else:
        return "-"
    return "y" if good else "n"


def _known(kind: str, s: str, digits: str) -> str:
    """The gazetteer labeler."""
    if kind == "email":
        host = s.rpartition("@")[2].lower()
        return "y" if host in _PROVIDERS or host.rpartition(".")[2] in _TLDS else "-"
    if kind == "iban":
        flat = s.replace(" ", "")
        return "y" if _IBAN.get(flat[:2]) == len(flat) else "n"
    if kind == "card":
        return "y" if any(a <= digits[: len(a)] <= b and len(digits) in n for a, b, n in _ISSUERS) else "n"
    if kind == "phone" and s[0] == "+":
        return "y" if any(digits[:k] in _DIAL for k in (1, 2, 3)) else "n"
    if kind == "secret":
        return "y" if re.match(r"sk[-_]|gh[pousr]_|AKIA|xox|eyJ|glpat-", s) or (len(s) in (32, 40, 64) and re.fullmatch("[0-9a-fA-F]+", s)) else "-"
    if kind == "ip":
        return "n" if re.match(r"(?:0|10|127|255)\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|(?:22[4-9]|23\d)\.", s) else "-"
    return "y" if kind == "address" else "-"  # its pattern is made of kinds of streets


LABELERS = 8
#: P(checksum passes) for what a checksum was made for (a digit in a thousand or so is mistyped, and numbers are made up in examples), and for chance numbers.
CHECKSUMS = {"card": (0.98, 0.1), "iban": (0.98, 1 / 97)}


def votes(kind: str, s: str, before: str, after: str) -> str:
    """A letter for each labeler: y, n, or - for no vote."""
    digits = re.sub(r"\D", "", s)
    strict = "-" if kind not in _STRICT else "y" if _STRICT[kind].fullmatch(s) else "n"
    context = "y" if _FOR[kind].search(before) or _FOR[kind].search(after) else "-"
    against = "n" if _AGAINST.search(before) else "-"
    shape = "n" if kind == "number" or kind == "phone" and _DATE.fullmatch(s) or len(set(digits)) == 1 and len(digits) > 4 else "-"
    edge = "y" if (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum()) else "n"
    people = "y" if _NAMES.search(before) or _NAMES.search(after) else "-"
    return strict + _valid(kind, s, digits) + _known(kind, s, digits) + context + against + shape + edge + people


def features(kind: str, s: str, before: str, after: str) -> str:
    """Features that the classifier sees besides the kind, a letter each: share of digits, length, character before and after, a letter case."""
    share = sum(c.isdigit() for c in s) * 3 // len(s)
    side = lambda c: "e" if not c else "s" if c.isspace() else "q" if c in "\"'<([=:" else "p" if not c.isalnum() else "a"
    return f"{share}{min(len(s) // 8, 7)}{side(before[-1:])}{side(after[:1])}{'u' if s.isupper() else 'l' if s.islower() else 'm'}"


_GAP, _HOT = np.zeros(128, bool), np.zeros(128, bool)
_GAP[[9, 10, 13, 32]] = True
_HOT[[*range(48, 58), 64]] = True
#: Words of a candidate before and after one with a digit or an at sign, at most, and one more to look ahead to.
_LEFT, _RIGHT = 1, 5


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole words that hold every candidate: those around words with a digit or an at sign."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
    gap = _GAP[c]
    hot = np.flatnonzero(_HOT[c])
    if not len(hot):
        return
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    bounds = np.concatenate([np.zeros(0 if gap[0] else 1, np.int64), edge, np.full(0 if gap[-1] else 1, len(c))])
    starts, ends = bounds[::2], bounds[1::2]
    word = np.unique(np.searchsorted(starts, hot, "right") - 1)
    first, last = np.maximum(word - _LEFT, 0), np.minimum(word + _RIGHT, len(starts) - 1)
    new = np.flatnonzero(first[1:] > last[:-1]) + 1
    yield from zip(starts[first[np.append(0, new)]].tolist(), ends[last[np.append(new - 1, len(last) - 1)]].tolist())


def spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, signature) of every candidate."""
    for x, y in windows(text):
        for m in _WIDE.finditer(text, x, y):
            a, b = m.span()
            kind = m.lastgroup if m.lastgroup != "sep" else "card"
            s = m[0]
            before, after = text[max(0, a - _NEAR) : a], text[b : b + _NEAR]
            yield a, b, kind, f"{kind}|{votes(kind, s, before, after)}|{features(kind, s, before, after)}"


_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(48, 58), 64]] = True


def _maybe(text: pa.Array) -> np.ndarray:
    """Rows with a digit or an at sign: any candidate has one."""
    data, off = buffers(text)
    return np.unique(np.searchsorted(off, np.flatnonzero(_MAYBE[data]), "right") - 1)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, signature)"""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = filled(batch.column(1))
            row, start, end, kind, sig = ([] for _ in range(5))
            for r in _maybe(text).tolist():
                for x in spans(text[r].as_py()):
                    for col, v in zip((row, start, end, kind, sig), (r, *x)):
                        col.append(v)
            yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "kind": pa.array(kind, pa.string()), "signature": pa.array(sig, pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).transform(text_batches).mapInArrow(look, "doc_id long, start int, end int, kind string, signature string")


def em(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict]:
    """Posterior by ``kind|votes`` and the reliabilities {(kind, labeler): [P(vote | not PII), P(vote | PII)]} with votes in the order y, n, -."""
    by: dict[str, dict[str, int]] = {}
    for sig, n in counts.items():
        kind, v, _ = sig.split("|")
        by.setdefault(kind, {})[v] = by.setdefault(kind, {}).get(v, 0) + n
    post, reliable = {}, {}
    for kind, table in by.items():
        vs = sorted(table)
        n = np.array([table[v] for v in vs], float)
        x = np.array([["yn-".index(c) for c in v] for v in vs])
        k = x.shape[1]
        # Dirichlet priors: a labeler is believed to be better than chance, and a kind's rate starts at even odds
        prior = np.array([[2.0, 6.0, 4.0], [6.0, 2.0, 4.0]])
        theta = np.tile(prior / prior.sum(1, keepdims=True), (k, 1, 1))
        if kind in CHECKSUMS:
            theta[1] = [[p, 1 - p, 1e-9] for p in CHECKSUMS[kind][::-1]]
        rate = 0.5
        for _ in range(rounds):
            like = np.log([1 - rate, rate])[None, :] + np.log(theta)[np.arange(k)[None, :], :, x].sum(1)
            q = np.exp(like - like.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            w = q * n[:, None]
            rate = (w[:, 1].sum() + 1) / (n.sum() + 2)
            for j in range(k):
                if j == 1 and kind in CHECKSUMS:
                    continue
                c = np.stack([np.bincount(x[:, j], w[:, y], minlength=3) for y in (0, 1)]) + prior
                theta[j] = c / c.sum(1, keepdims=True)
        post |= {f"{kind}|{v}": float(p) for v, p in zip(vs, q[:, 1])}
        reliable |= {(kind, j): theta[j].tolist() for j in range(k)}
    return post, reliable


def names_of(sig: str) -> list[str]:
    """What the classifier sees of a signature: kind, features, and each labeler's vote for the kind."""
    kind, v, f = sig.split("|")
    return [kind, *(f"{kind}:v{j}{c}" for j, c in enumerate(v) if c != "-"), *(f"f{j}{c}" for j, c in enumerate(f)), *(f"{kind}:f{j}{c}" for j, c in enumerate(f))]


L2 = 1e-5


def classifier(counts: dict[str, int], post: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """Span probability by signature: logistic regression, fitted to the posteriors with every span's weight by Newton's method (with halved steps where a whole one is too long)."""
    sigs = sorted(counts)
    names: dict[str, int] = {}
    at = [[names.setdefault(n, len(names)) for n in names_of(sig)] for sig in sigs]
    x = np.zeros((len(sigs), len(names) + 1))
    x[:, -1] = 1
    for i, cols in enumerate(at):
        x[i, cols] = 1
    n = np.array([counts[s] for s in sigs], float)
    n /= max(n.sum(), 1)
    y = np.array([post[s.rpartition("|")[0]] for s in sigs])

    def loss(w):
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + L2 / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + L2 * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + L2 * np.eye(len(w)), grad)
        scale = 1.0
        while (new := loss(w - scale * step)) > now and scale > 1e-6:
            scale /= 2
        w, before, now = w - scale * step, now, new
        if before - now < 1e-12:
            break
    return dict(zip(sigs, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def model(cands: DataFrame) -> dict[str, float]:
    """Span probability by signature, from counts over all candidates."""
    counts = {r["signature"]: r["n"] for r in cands.groupBy("signature").agg(F.count("*").alias("n")).collect()}
    return classifier(counts, em(counts)[0]) if counts else {}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, start, end, kind, p): the spans taken for personal data, in [start, end) of the text."""
    cands = checkpoint(candidates(docs, id_col, text_col))
    table = docs.sparkSession.createDataFrame(list(model(cands).items()), "signature string, p double")
    return cands.join(table, "signature").filter(F.col("p") >= least).select("doc_id", "start", "end", "kind", "p")


def redact_text(text: str, table: dict[str, float], least: float) -> str:
    out, at = [], 0
    for a, b, kind, sig in spans(text):
        if table.get(sig, 0.0) >= least:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents with each reported span replaced by its kind in brackets; all columns stay."""
    table = docs.sparkSession.sparkContext.broadcast(model(candidates(docs, id_col, text_col)))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = filled(batch.column(at))
            new = {r: t for r in _maybe(text).tolist() if (t := redact_text(old := text[r].as_py(), table.value, least)) is not old}
            if new:
                mask = np.zeros(len(text), bool)
                mask[list(new)] = True
                col = pc.replace_with_mask(batch.column(at).cast(pa.large_string()), pa.array(mask), pa.array([new[r] for r in sorted(new)], pa.large_string()))
                batch = pa.RecordBatch.from_arrays([c if i != at else col.cast(batch.schema.field(at).type) for i, c in enumerate(batch.columns)], batch.schema.names)
            yield batch

    return text_batches(docs).mapInArrow(clean, docs.schema)

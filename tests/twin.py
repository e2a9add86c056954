"""Plain-Python statement of the detection semantics, used only for comparison."""

import math
import re

from hushscan.functions import patterns as P


def python_regex(rule):
    """The rule in Python's dialect: flags differ, and \\s already has \\x1c-\\x1f."""
    return re.compile(rule.regex, re.I if rule.folded else 0)


REGEXES = {rule.kind: python_regex(rule) for rule in P.BUILTIN_RULES}
CANDIDATE = re.compile(P.ENTROPY_CANDIDATE.removeprefix("(?dU)"))
URL = re.compile(P.URL.removeprefix("(?idU)"), re.I)


def entropy(s):
    counts = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    return sum(-(n / len(s)) * math.log2(n / len(s)) for n in counts.values())


def filler(v):
    runs = re.findall("[A-Za-z0-9]+", v)
    longest = ""
    for r in runs:
        if len(r) > len(longest):
            longest = r
    return bool(longest) and len(set(longest)) <= 3


def masked(text):
    def hide(m):
        u = m.group()
        head = re.match("[^?#]*", u).group()
        tail = u[len(head):]
        at = head.find("://")
        if at >= 0:
            login = re.match("(?s)^.*@", head[at + 3:].split("/", 1)[0])
            if login:
                keep = at + 3 + login.end()
                return " " * (at + 3) + head[at + 3: keep] + " " * (len(head) - keep) + tail
        return " " * len(head) + tail

    return URL.sub(hide, text)


def raw(text, threshold=4.2):
    out = []
    for rule in P.BUILTIN_RULES:
        for m in REGEXES[rule.kind].finditer(text):
            if rule.reject_filler and filler(m.group()):
                continue
            group = 2 if rule.labelled else 0
            out.append((m.start(group), m.end(group), rule.order, rule.kind))
    for m in CANDIDATE.finditer(masked(text)):
        v = m.group()
        low = v.lower()
        if any(w in low for w in P.ENTROPY_IGNORED_WORDS) or len(set(v)) <= 2 or v.isdigit():
            continue
        if round(entropy(v), 9) >= threshold:
            out.append((m.start(), m.end(), P.ENTROPY_ORDER, P.ENTROPY_KIND))
    return out


def merged(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if kept and s[0] < kept[-1][1]:
            if s[1] - s[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def detect(text, threshold=4.2):
    return [(s, e, k) for s, e, _, k in merged(raw(text, threshold))]


def redact(text, mask="********"):
    out, at = [], 0
    for s, e, _ in detect(text):
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


def region(text, offset):
    line = text.count("\n", 0, offset) + 1
    begin = text.rfind("\n", 0, offset) + 1
    return line, len(text[begin:offset].encode("utf-16-le", "surrogatepass")) // 2 + 1


def placeholder(value):
    v = value.strip().strip("'\"").lower()
    return (
        v in P.PLACEHOLDER_VALUES
        or (v.startswith("your") and any(h in v for h in P.PLACEHOLDER_HINTS))
        or (bool(v) and set(v) == {"x"})
    )

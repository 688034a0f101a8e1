"""Plain Python versions of the llm operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept, what is kept) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def grams(text, words=5):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)])


def linked_components(ids, texts, percent=75):
    """(n_shingles, component_id) of every text, by comparing all pairs."""
    sets, own = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                own[find(i)] = find(j)
    known = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            known[r] = min(known.get(r, d), d)
    return [(len(s), known.get(find(i))) for i, s in enumerate(sets)]


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def _any_case(s):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)


ASSIGN = re.compile("(" + "|".join(map(_any_case, ["password", "passwd", "secret", "token"])) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans (start, kind number, end) and their written form."""
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in sorted(found))


def segmentation(text, scores, byte_ids, unknown):
    """Best unigram segmentation; ties to the longer last piece."""
    if not text:
        return []
    t = "▁" + text.replace(" ", "▁")
    longest = max(map(len, scores))
    best, back = [0.0] + [float("-inf")] * len(t), [None] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - longest), e):
            piece = t[s:e]
            if piece in scores:
                cost, ids = best[s] + scores[piece][0], [scores[piece][1]]
            elif e - s == 1:
                cost, ids = best[s] + unknown, [byte_ids[b] for b in piece.encode()]
            else:
                continue
            if cost > best[e]:
                best[e], back[e] = cost, (s, ids)
    out, e = [], len(t)
    while e:
        s, ids = back[e]
        out, e = ids + out, s
    return out


# --- addresses and their aliases -----------------------------------------------------------

def split_url(url):
    """host, path, query of a url, as the contract reads them."""
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    rest = rest[len(host):].split("#", 1)[0]
    path, mark, query = rest.partition("?")
    return host.translate(FOLD), path, mark + query


def remove_dots(path):
    """RFC 3986, section 5.2.4, for a path that begins with a slash."""
    out = []
    while path:
        if path.startswith("/../") or path == "/..":
            path = "/" + path[4:]
            out = out[:-1]
        elif path.startswith("/./") or path == "/.":
            path = "/" + path[3:]
        else:
            end = path.find("/", 1)
            end = len(path) if end < 0 else end
            out.append(path[:end])
            path = path[end:]
    return "".join(out)


def verdicts(pages, rules):
    """{page_id: (host, path, rule, verdict)} of (page_id, url, [targets as written, decoded])."""
    from urllib.parse import urljoin

    def rule_of(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(str(r)), default=None)

    own, blocked = {}, set()

    def find(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    def node(url, dots=False):
        host, path, query = split_url(url)
        if not host:
            return None
        name = host + remove_dots(path or "/") + query
        rule = rule_of(host, remove_dots(path) if dots and path else path)
        return name, rule is not None and not rule.allow

    for _, url, targets in pages:
        a = node(url)
        for target in targets if a else []:
            b = node(urljoin(url, target), True) if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?!//)", target) and not target.startswith("#") and target else None
            if b:
                own[find(a[0])] = find(b[0])
                blocked |= {x for x, bad in (a, b) if bad}
    roots = {find(x) for x in blocked}
    out = {}
    for page, url, _ in pages:
        host, path, _ = split_url(url)
        rule, a = rule_of(host, path), node(url)
        verdict = ("allow" if rule.allow else "block") if rule else "block" if a and a[0] in own and find(a[0]) in roots else "allow"
        out[page] = (host, path, str(rule) if rule else None, verdict)
    return out


# --- Merkle manifest -------------------------------------------------------------------------

def _hash(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(fields):
    return _hash(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(nodes):
    """The root of a list of digests, and for each of them (siblings, fold of another digest in its place)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    sides = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            j = i + 1 if i % 2 == 0 else i - 1
            steps.append((i % 2, level[j] if j < len(level) else None))
            i //= 2
        sides.append(steps)
    return levels[-1][0], sides


def merkle(rows, changed):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    own = {}
    for name in names:
        mine = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[name] = mine, *_tree([leaf(r) for r in mine])
    root, top = _tree([own[n][1] for n in names])
    out = []
    for name, above in zip(names, top, strict=True):
        mine, subroot, sides = own[name]
        for r, steps in zip(mine, sides, strict=True):
            digest = leaf((*r[:3], r[3] + 1, r[4]) if changed(r[0]) and r[3] is not None else r)
            for side, other in [*steps, *above]:
                digest = _hash(digest) if other is None else _hash(other, digest) if side else _hash(digest, other)
            out.append((r[0], leaf(r), subroot, root, _hash(*(x for _, x in [*steps, *above] if x)), digest, digest == root))
    return out

"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    t = (text or "").translate(LOWER) if lower else text or ""
    return [w for w in SPACE.split(t) if w]


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_groups(docs, width=5):
    sets = {}
    for i, t in docs.items():
        w = words(t, True)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def remove_repeats(docs, width=20):
    seen, out = set(), {}
    for i in sorted(docs):
        w = words(docs[i])
        gone = set()
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone |= set(range(k, k + width))
            seen.add(x)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def drop_lines(docs, chars=20, least=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(where[key(x)]) < least or i == max(where[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def quality(text):
    w, t = words(text), text or ""
    lines = t.split("\n")
    wordy = [x for x in lines if words(x)]
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k : k + 8])].append(k)
    covered = {j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    n, chars = len(w), sum(map(len, w))
    symbols, upper = sum(t.count(c) for c in "#*$%&|<>"), len(re.findall("[A-Z]", t))
    dup = len(wordy) - len(set(wordy))
    failed = n < 20 or 100 * len(covered) > 30 * n
    bad = failed or 100 * symbols > 30 * n or 100 * dup > 50 * len(lines) or 100 * upper > 50 * chars or chars < 2 * n or chars > 15 * n or 100 * len(set(w)) < 5 * min(n, 1000)
    return n, chars, symbols, dup, len(covered), failed, not bad


def pii(text):
    t = text or ""
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]


def ppm(train, texts, order):
    counts = defaultdict(Counter)
    pad = lambda x: [256] * order + list((x or "").translate(LOWER).encode()) + [256]
    for s in map(pad, train):
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for s in map(pad, texts):
        total = 0.0
        for i in range(order, len(s)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                left = {a: n for a, n in counts.get(tuple(s[i - k : i]), {}).items() if a not in excluded}
                if not left:
                    continue
                t, d = sum(left.values()), len(left)
                if s[i] in left:
                    p *= left[s[i]] / (t + d)
                    break
                p *= d / (t + d)
                excluded |= set(left)
            else:
                p /= 257 - len(excluded)
            total += math.log10(p)
        out.append(total)
    return out


def mix(rows, weights=(5.0, 2.0, 1.0), share=1.5, cap=2):
    """rows: (doc_id, source, size) -> copies of each row."""
    total = defaultdict(int)
    for _, s, n in rows:
        total[s] += n
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(total.values()) - sum(cap * total[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: cap * total[s] if s in capped else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and target[s] > cap * total[s] - 1e-9}
        if not over:
            break
        capped |= over
    place = lambda i: int(hashlib.md5(f"mix{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    copies = {}
    for s in names:
        passes = min(cap, int(target[s] / total[s])) if total[s] else 0
        need, upto, limit = target[s] - passes * total[s], 0, -1
        if need > 0 and passes < cap:
            by_hash = defaultdict(int)
            for i, x, n in rows:
                if x == s:
                    by_hash[place(i)] += n
            for h in sorted(by_hash):
                upto += by_hash[h]
                limit = h
                if upto >= need:
                    if 2 * (need - upto + by_hash[h]) < by_hash[h]:
                        limit = h - 1
                    break
        for i, x, _ in rows:
            if x == s:
                copies[i] = passes + (place(i) <= limit)
    return copies


def disclosing(docs, reach=6, apart=1.0, generalise_at=0.75, remove_at=0.9):
    """doc_id -> sorted (kind, start, end) of the words that reveal an entity beside them."""
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w.translate(LOWER))
    total, c_t, c_e, c_te, near = 0, Counter(), Counter(), Counter(), []
    for i, t in docs.items():
        t = t or ""
        ws = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        total += len(ws)
        c_t.update(strip(t[a:b]) for a, b in ws)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in pii(t))]
        for kind, a, b in spans:
            entity = (kind, t[a:b])
            c_e[entity] += 1
            left, right = [w for w in ws if w[1] < a][-reach:], [w for w in ws if w[0] > b][:reach]
            for x, y in left + right:
                term = strip(t[x:y])
                if term and not any(p < y and x < q for _, p, q in spans):
                    c_te[entity, term] += 1
                    near.append((i, x, y, entity, term))
    best = {}
    for i, x, y, entity, term in near:
        information = math.log(total / c_e[entity])
        if information > 0:
            share = 1 - math.log(max(1.0, (c_t[term] + apart) / c_te[entity, term])) / information
            if share >= generalise_at:
                best[i, x, y] = max(best.get((i, x, y), 0), share)
    out = defaultdict(list)
    for (i, x, y), share in best.items():
        out[i].append(("removed" if share >= remove_at else "general", x, y))
    return {i: sorted(v, key=lambda s: s[1]) for i, v in out.items()}


class _Visible(HTMLParser):
    """Words between tags that no unseen or hidden element holds; for well-formed pages."""

    UNSEEN = frozenset("head title script style template noscript iframe canvas audio video datalist".split())
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time tt u var".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.text.append(" ")
        if tag not in self.VOID:
            attrs = dict(reversed(attrs))
            style = re.sub(r"\s", "", (attrs.get("style") or "").lower())
            self.open.append((tag, tag in self.UNSEEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.text.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not any(unseen for _, unseen in self.open):
            self.text.append(data)


def visible_words(source):
    parser = _Visible()
    parser.feed(source or "")
    parser.close()
    return Counter("".join(parser.text).split())


def terms(text, digits=False):
    """Runs of letters (and digits), everything outside ASCII being a letter."""
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def audit(rows, min_docs, ranks):
    """Rows of the source audit for (lang, source, text)."""
    seen, by_lang, by_group, out = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        found = terms(text)
        seen[lang or ""].update(set(found))
        by_group[lang or "", source or ""].update(found)
        by_lang[lang or ""].update(found)
    for lang in seen:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, groups = shares(by_lang[lang]), {s: shares(c) for (l, s), c in by_group.items() if l == lang}
        for s, p in groups.items():
            pairs = [(-sum(f(p[t], o[t]) for t in kept), x.encode()) for x, o in groups.items() if x != s]
            own = [(-f(p[t], q[t]), t.encode()) for t in kept if by_group[lang, s][t] and p[t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", own)) for k, (v, i) in enumerate(sorted(found), 1) if part == "pair" or k <= ranks]
    return sorted(out)


def lexical(docs, items, k):
    """(item, rank, id, score) for docs of (id, text) and items of (item, text)."""
    texts = [(i, terms(t, True)) for i, t in docs]
    texts = [(i, len(w), Counter(w)) for i, w in texts if w]
    n_docs, n_terms = len(texts), sum(n for _, n, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    asked, out = defaultdict(Counter), []
    for item, text in items:
        asked[item].update(terms(text, True))
    for item, want in asked.items():
        found = []
        for i, n, c in texts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in want.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def split_run(run, cost, first, more, longest):
    """Cheapest total cost and words of a split of a run, over all splits."""
    best = [(0, [])]
    for i in range(1, len(run) + 1):
        options = []
        for j in range(i):
            w = run[j:i]
            if w in cost and len(w) <= longest:
                options.append((best[j][0] + cost[w], len(best[j][1]) + 1, 0, len(w), best[j][1] + [w]))
            options.append((best[j][0] + first + more * (len(w) - 1), len(best[j][1]) + 1, 1, len(w), best[j][1] + [w]))
        x = min(options)
        best.append((x[0], x[4]))
    return best[-1]


def judge_urls(pages, rules, longest=20):
    """(id, host, path, rule, verdict, score) for pages of (id, url, html)."""
    scaled = lambda x: math.floor(1_000_000 * math.log(x))
    counts = Counter(t for _, _, h in pages for t in terms(re.sub(r"<[^<>]*>", " ", h or "")))
    total = sum(counts.values()) or 1
    cost = {t: scaled(total / n) for t, n in counts.items() if len(t) <= longest}
    rows, seen, classes = [], {"block": Counter(), "allow": Counter()}, Counter()
    for i, url, _ in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in rules if (host == (n := r.split("/")[0]) or host.endswith("." + n)) and path.startswith(r[len(n) :])]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        words = [w for run in terms(host) for w in split_run(run, cost, scaled(total), scaled(10), longest)[1]] + terms(path)
        rows.append((i, host, path, rule, verdict, words))
        if rule:
            seen[verdict].update(words)
            classes[verdict] += 1
    v, b, a = len({*seen["block"], *seen["allow"]}), sum(seen["block"].values()), sum(seen["allow"].values())
    weight = lambda x, y: scaled((x + 1) / max(1, b + v)) - scaled((y + 1) / max(1, a + v))
    prior = scaled(classes["block"] + 1) - scaled(classes["allow"] + 1)
    out = []
    for i, host, path, rule, verdict, words in rows:
        score = None if rule else prior + sum(weight(seen["block"][w], seen["allow"][w]) for w in words)
        out.append((i, host, path, rule, verdict or ("block" if score > 0 else "allow"), score))
    return out

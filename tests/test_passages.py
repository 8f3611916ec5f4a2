"""Page slices, section and description anchors, group contexts and quote ranges against plain sequential models."""

import random
import re

import pytest

from docloom.operators import passages as P

PAGES = "doc_id bigint, page_number int, text string"
GROUPS = {
    "bonds": ["bid bond", "surety", "certified check"], "location_and_size": ["location:", "county", " to "], "set_asides": ["mbe"],
    "dates_notes": ["site visit", "mandatory"],
}


def corpus(seed, docs=25):
    rnd = random.Random(seed)
    bits = ["the vendor shall build. ", "Bid bond and surety apply. ", "LOCATION: Main Street, county of X. ", "a site visit is mandatory! ", "lorem ipsum ", "1. One\n2. Two\n3. Three\n", "\n\n",
            "certified check\n", "MBE goal. ", "\nScope of Work\n", "\nSECTION C: SCOPE OF WORK\n", "\n3.1. Project Description the office. ", "in the scope of work of it ", "é " * 40, "word " * 90, P.OVERVIEW + " by the county. ", "Table of  Contents "]
    out = []
    for d in range(docs):
        for p in range(1, rnd.randint(1, 30)):
            if rnd.random() < 0.9:
                out.append((d, p, None if rnd.random() < 0.05 else "".join(rnd.choices(bits, weights=[3, 1, 1, 1, 4, 1, 2, 1, 1, 1, 1, 1, 1, 1, 2, 0.2, 0.4], k=rnd.randint(0, 12)))))
    return out


def by_doc(rows):
    docs = {}
    for d, p, t in sorted(rows, key=lambda r: r[:2]):
        docs.setdefault(d, []).append((p, t or ""))
    return docs


def plain_slice(pages, words, opening, budget):
    scores = {}
    for p, t in pages:
        n = sum(w in t.lower() for w in words)
        if n:
            scores[p] = scores.get(p, 0) + 10 * n
            for q in (p - 1, p + 1):
                scores[q] = scores.get(q, 0) + 1
    if opening:
        for p, _ in pages[:5]:
            scores[p] = scores.get(p, 0) + 5
    texts, used, out = {p: t.strip() for p, t in pages}, 0, []
    for p in sorted(scores, key=lambda k: (-scores[k], k)):
        if texts.get(p):
            fits = used + len(texts[p]) + 20 <= budget
            used += fits * (len(texts[p]) + 20)
            out.append((p, scores[p], fits))
    return out


@pytest.mark.parametrize("budget", [0, 900, 10**6])
def test_page_slice_equals_the_greedy_choice(spark, budget):
    rows = corpus(budget)
    got = sorted(map(tuple, P.page_slice(spark.createDataFrame(rows, PAGES).repartition(5), GROUPS, budget).collect()))
    want = sorted((d, g, *x) for d, pages in by_doc(rows).items() for g, words in GROUPS.items() for x in plain_slice(pages, words, g == "location_and_size", budget))
    assert got == want and {r[4] for r in got} == ({False} if budget == 0 else {True} if budget == 10**6 else {True, False})


def quality(after):
    after = after[:800].strip()
    if not after:
        return 0
    prose = len(re.findall(r"\b(?:the|shall|contractor|vendor|county|office|design|build)\b", after[:500], re.I))
    score = len(after) + 50 * prose + 20 * len(re.findall(r"[.!?]", after))
    return max(1, score // 10) if len(re.findall(r"^\s*\d+\.\s+\w", after[:300], re.M)) >= 2 and prose < 2 else score


@pytest.mark.parametrize("size", [None, 60])
def test_best_section_is_the_first_of_the_best(spark, size):
    texts = [(d, "".join(t for _, t in pages)) for d, pages in by_doc(corpus(3)).items()] + [(90, None), (91, ""), (92, "Scope of Work"), (93, "Scope of WorkScope of Work x")]
    needles = ["Scope of Work", "SCOPE OF WORK", "Project Description"]
    got = {r.doc_id: (r.start, r.score, r.section) for r in P.best_section_slice(spark.createDataFrame(texts, "doc_id bigint, text string"), needles, size).collect()}
    want = {}
    for d, t in texts:
        best = 0
        for n in needles:
            at = (t or "").find(n)
            while at >= 0:
                part = t[at:] if size is None else t[at : at + size]
                if quality(part[len(n) :]) > best:
                    best = quality(part[len(n) :])
                    want[d] = (at + 1, best, part)
                at = t.find(n, at + len(n))
    assert got == want and len(got) > 10


HEADING = re.compile(r"^[ \t]*(?:SECTION\s+[A-Z0-9]+\s*[:.\-–]?\s*|[A-Z0-9]+(?:\.\d+)*[:.)]\s+)?(?:Scope of Work|Project Description|Description of Work|Statement of Work|Introduction)\b", re.I | re.M)


def plain_description(pages):
    best, anchor = 0, None
    for p, t in pages:
        if re.search(r"\btable\s+of\s+contents\b", t[:2000], re.I):
            continue
        at = t.find(P.OVERVIEW)
        found = [2 * quality(t[at + len(P.OVERVIEW) :])] if at >= 0 else [quality(t[m.end() :]) for m in HEADING.finditer(t)]
        if max(found, default=0) > best:
            best, anchor = max(found), p
    anchor = anchor if best >= 80 else None
    first, last = (max(1, anchor - 1), anchor + 4) if anchor is not None else (15, 21)
    return anchor, [(p, t) for p, t in pages if first <= p <= last and t.strip()]


def test_description_pages_lie_around_the_best_prose(spark):
    rows, budget = corpus(4, 60), 700
    got = sorted((r.doc_id, r.page_number, r.anchor_page, r.start, r.inside) for r in P.description_pages(spark.createDataFrame(rows, PAGES), budget).collect())
    want, anchored = [], 0
    for d, pages in by_doc(rows).items():
        anchor, kept = plain_description(pages)
        anchored += anchor is not None
        at = 0
        for p, t in kept:
            want.append((d, p, anchor, at, at < budget))
            at += len(f"--- Page {p} ---\n{t.strip()}") + 2
    assert got == sorted(want) and 5 < anchored < 60


def test_contents_pages_and_bare_headings_never_anchor(spark):
    prose = "The vendor shall build the county office. " * 5
    rows = [(1, 1, "Table of Contents\nScope of Work\n" + prose), (1, 2, "as said in the scope of work, " + prose), (1, 3, "SECTION C: SCOPE OF WORK\n" + prose), (1, 9, "x"), (2, 1, "Scope of Work\nnone"), (2, 16, "y")]
    got = {(r.doc_id, r.page_number, r.anchor_page) for r in P.description_pages(spark.createDataFrame(rows, PAGES), 10**6).collect()}
    assert got == {(1, 2, 3), (1, 3, 3), (2, 16, None)}


def test_group_context_follows_the_plans(spark):
    rows, budget = corpus(6, 40), 1200
    df = spark.createDataFrame(rows, PAGES)
    got = {}
    for r in sorted(P.group_context(df, GROUPS, budget).collect(), key=lambda r: r.position):
        got.setdefault((r.doc_id, r.group_id), []).append((r.source, r.page_number, r.selected))
    for d, pages in by_doc(rows).items():
        filled = lambda part: [(p, t) for p, t in part if t.strip()]
        whole = [("document", p, True) for p, _ in filled(pages)]
        words = lambda g: sorted(("keyword", p, s) for p, _, s in plain_slice(pages, GROUPS[g], g == "location_and_size", budget))
        usable = lambda x: any(s for *_, s in x)
        cover = [("cover", p, True) for p, _ in filled(pages[:5])]
        dates = cover + [k for k in words("dates_notes") if k[1] not in {p for p, _ in pages[:5]}]
        near = [("description", p, True) for p, _ in plain_description(pages)[1]]
        body = [("body", p, True) for p, _ in filled(pages[1:25])]
        want = {"dates": dates if usable(dates) else whole, "project_description": near or body or whole, "project_identity": [("head", p, True) for p, _ in filled(pages[:8])] or whole}
        want |= {g: words(g) if usable(words(g)) else whole for g in GROUPS if g != "dates_notes"}
        for g, parts in want.items():
            assert got.get((d, g), []) == parts, (d, g)
    texts = {(r.doc_id, r.group_id): r.text for r in P.context_text(P.group_context(df, GROUPS, budget), df).collect()}
    d, pages = next((d, p) for d, p in by_doc(rows).items() if len(p) > 3)
    assert texts[d, "project_identity"] == "\n\n".join(f"--- Page {p} ---\n{t.strip()}" for p, t in pages[:8] if t.strip())


def plain_even(text):
    s = (text or "").lower().replace("­", "")
    s = re.sub(r"\s+", " ", re.sub(r"-\s*\n\s*", "", s))
    s = re.sub("['‚]", "'", re.sub('["„]', '"', s)).replace("�", "")
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s\"'.,;:$%()/\-]", " ", s)).strip()


def plain_range(h, n):
    if not h or not n:
        return None
    words = n.split(" ")
    least = min(6, max(3, -(-len(words) * 2 // 5)))
    tries = [("full", n, len(n))]
    tries += [("prefix", " ".join(words[:w]), None) for w in range(len(words), least - 1, -1)] + [("suffix", " ".join(words[-w:]), None) for w in range(len(words), least - 1, -1)]
    tries += [("slice", n[:k], None) for k in (48, 32, 24, 20) if len(n) >= k]
    anchor = " ".join(words[:3])
    if len(words) >= 3 and len(anchor) >= 12:
        tries.append(("anchor", anchor, min(len(n), len(anchor) + 40)))
    return next(((tier, h.find(t), size or len(t)) for tier, t, size in tries if t in h), None)


def test_quote_ranges_equal_the_tiers(spark):
    rnd = random.Random(11)
    words = ["Bid", "bond", "“due”", "da-\nte", "so­ft", "Straße", "10:00", "the", "owner's", "İstanbul", "|", "$5", "�"]
    line = lambda k: rnd.choice([" ", "  ", "\n", " "]).join(rnd.choices(words, k=k))
    pages = [(d, p, line(rnd.randint(0, 60)) or None) for d in range(8) for p in range(1, 9)]
    quotes = []
    for k in range(200):
        d, p, t = rnd.choice(pages)
        own = (t or "none at all").split()
        a = rnd.randrange(len(own))
        cut = own[a : a + rnd.randint(1, 14)]
        if rnd.random() < 0.4:
            cut[rnd.randrange(len(cut))] = "changed"
        quotes.append((d, k, " ".join(cut), p + rnd.randint(-4, 4)))
    got = {r.item_id: r for r in P.locate_quote(spark.createDataFrame(quotes, "doc_id bigint, item_id int, source_text string, page int"), spark.createDataFrame(pages, PAGES)).collect()}
    texts, tiers = {(d, p): t for d, p, t in pages}, set()
    for d, k, q, hint in quotes:
        want = None
        for off in (0, 1, -1, 2, -2, 3, -3):
            found = plain_range(plain_even(texts.get((d, hint + off))), plain_even(q))
            if found:
                want = (hint + off, *found)
                break
        r = got.get(k)
        assert (r and (r.page_number, r.tier, r.norm_start, r.norm_length)) == want, q
        if r and r.tier != "anchor":
            tiers.add(r.tier)
            norm, at = P.evened(texts[d, r.page_number])
            piece = texts[d, r.page_number][r.start : r.end]
            assert plain_even(piece) == norm[r.norm_start : r.norm_start + r.norm_length].strip()
    assert {"full", "prefix", "suffix"} <= tiers and len(got) > 100

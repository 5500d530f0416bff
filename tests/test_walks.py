"""Page walks against a walk that goes from page to page."""

import random

from tallyforge.operators import walks as K

PAGES = "listing long, page int, signature string, keys array<string>, clicks boolean"


def by_hand(pages, limit):
    """pages: {number: (signature, keys or None, clicks)} of one listing -> rows (page, cards, new, repeats, already read, stop)."""
    limit = min(limit, 100) if limit > 0 else 100
    out, known, prints, page = [], set(), set(), 1
    while page <= limit:
        signature, keys, clicks = pages.get(page, (None, None, False))
        if not keys:
            unknown = keys is None
            out.append((page, 0, 0, 0, False, ("no lots found" if unknown else "no active lots") if page == 1 else "no such page" if unknown else "no more lots"))
            break
        new = 0
        for key in keys:
            if key not in known:
                known.add(key)
                new += 1
        again = page > 1 and signature is not None and signature in prints
        stop = None
        if again and not clicks:
            stop = "page already read"
        elif page == limit:
            stop = "page limit"
        out.append((page, len(keys), new, len(keys) - new, again, stop))
        if stop:
            break
        if signature is not None:
            prints.add(signature)
        page += 1
    return out


def test_random_walks(spark):
    rng = random.Random(2)
    listings = {}
    for n in range(250):
        pages = {}
        for page in range(1, rng.randint(1, 9)):
            if rng.random() < 0.06:
                continue
            keys = None if rng.random() < 0.04 else [] if rng.random() < 0.06 else [rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 6))]
            pages[page] = (rng.choice(["s1", "s2", "s3", "s4", "s5", "s6", None]), keys, rng.random() < 0.5)
        if pages:
            listings[n if n else None] = pages
    rows = [(n, page, *p) for n, pages in listings.items() for page, p in pages.items()]
    for limit in (0, 4):
        got = {}
        for r in K.walked(spark.createDataFrame(rows, PAGES), limit).collect():
            got.setdefault(r.listing, []).append((r.page, r.cards, r.new_lots, r.repeats, r.already_read, r.stop))
        want = {n: by_hand(p, limit) for n, p in listings.items() if any(page <= (limit or 100) for page in p)}
        assert {n: sorted(x) for n, x in got.items()} == want


def test_a_repeated_page_still_gives_its_new_lots(spark):
    """The signature covers the first cards only: a page that looks read can hold a lot that was not."""
    rows = [(1, 1, "s1", ["a", "b"], False), (1, 2, "s2", ["b", "c"], False), (1, 3, "s2", ["c", "d"], False), (1, 4, "s3", ["e"], False)]
    got = sorted(tuple(r)[1:] for r in K.walked(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(1, 2, 2, 0, False, None), (2, 2, 1, 1, False, None), (3, 2, 1, 1, True, "page already read")]


def test_no_rows_no_clicks_and_the_page_guard(spark):
    assert K.walked(spark.createDataFrame([], PAGES)).collect() == []
    long = spark.range(1, 131).selectExpr("7L as listing", "cast(id as int) as page", "cast(id as string) as signature", "array(cast(id as string)) as keys", "'x' as stop")
    got = sorted((r.page, r.stop) for r in K.walked(long, -1).collect())
    assert len(got) == 100 and got[-1] == (100, "page limit") and all(stop is None for _, stop in got[:-1])
    odd = spark.createDataFrame([(1, None, "s", ["a"], False), (1, 0, "s", ["a"], False), (2, 3, "s", ["a"], None)], PAGES)
    assert [tuple(r) for r in K.walked(odd).collect()] == [(2, 1, 0, 0, 0, False, "no lots found")]

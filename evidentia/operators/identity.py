"""Entity resolution: exact identities with conflicts checked, and first-wins merging of records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterable, Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import cleaning as T
from evidentia.operators.graph import components, hot_join
from evidentia.sources.sinks import materialize

#: What may link two records, and what must not differ among the records of a group.
IDENTITIES = ("doi", "arxiv", "semantic", "pdf", "work")
EXCLUSIVE = ("doi", "arxiv", "semantic")
#: Characters that a title needs to identify a work.
LEAST_TITLE = 16
#: Distinct identities of a component with conflicts that one task may replay: some 100 MB.
TASK_ROWS = 100_000
#: Edges of groups that one task may settle: 8 MB of numbers.
TASK_EDGES = 500_000


def with_identifiers(papers: DataFrame) -> DataFrame:
    """papers with normal doi, arxiv and semantic columns; what isn't valid is null."""
    return papers.withColumns({"arxiv": T.arxiv(F.col("arxiv_id"), F.col("url")), "doi": T.doi(F.col("doi")), "semantic": T.semantic_id(F.col("semantic_id"))})


def work_key(title: Column, year: Column, authors: Column, least: int = LEAST_TITLE) -> Column:
    """One digest for the records of equal title, year and set of authors; null where a title is short or a part is missing."""
    name = T.folded_title(title)
    people = F.array_sort(F.array_distinct(F.filter(F.transform(authors, T.bare_name), lambda x: x != "")))
    whole = (F.length(name) >= least) & year.isNotNull() & (F.size(people) > 0)
    return F.when(whole, F.sha2(F.concat_ws("\x1f", name, year.cast("string"), F.array_join(people, "\x1e")), 256))


def keys(rows: DataFrame, names: Sequence[str] = IDENTITIES) -> DataFrame:
    """(id, key): an identity of a row in each line."""
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(n + ":"), F.col(n))) for n in names]))).alias("key"))


def candidate_links(rows: DataFrame, names: Sequence[str] = IDENTITIES) -> DataFrame:
    """(left, right, key): each row of a key but the first, with the first; a key of many rows gives as many links."""
    known = keys(rows, names)
    first = known.groupBy("key").agg(F.min("id").alias("left"))
    return known.join(first, "key").where("id <> left").select("left", F.col("id").alias("right"), "key").distinct()


#: The ways to have some of three exclusive identifiers, as bits, and the ways to have some of these.
PARTS = [[part for part in range(8) if part & mine == part] for mine in range(8)]


def _united(steps: Sequence[tuple[int, Hashable]], held: dict[int, tuple[str | None, ...]]) -> dict[int, int]:
    """The group of each node of held (values of EXCLUSIVE): nodes, in the order of their steps, join the groups that their key has
    met, the first met first, unless exclusive identifiers of both sides differ.

    A key's groups are looked up by the values that they share with each pattern of missing identifiers, so those that clash are not
    tried. A group is entered anew where it gets an identifier, three times at most, or joins one of more keys, so the work is near
    linear in the steps. What a group has passed by will never fit it, so the first that fits is the next in order.
    """
    often = Counter(key for _, key in steps)
    root, lowest = {x: x for x in held}, {x: x for x in held}
    told = {x: sum(1 << n for n, v in enumerate(own) if v is not None) for x, own in held.items()}
    met: dict[int, dict[Hashable, int]] = {x: {} for x in held}  # a group's keys, with its place in each key's order
    entries: dict[tuple, list[tuple[int, int]]] = {}  # heaps of (place, group); outdated ones are dropped when they come up
    kinds: dict[Hashable, set[int]] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def enter(g: int, key: Hashable) -> None:
        mine, own = told[g], held[g]
        kinds.setdefault(key, set()).add(mine)
        for part in PARTS[mine]:
            heappush(entries.setdefault((key, mine, *_shared(own, part)), []), (met[g][key], g))

    def first_fit(g: int, key: Hashable) -> int | None:
        best = None
        for kind in kinds.get(key, ()):
            heap = entries.get((key, kind, *_shared(held[g], told[g] & kind)), ())
            while heap and (root[heap[0][1]] != heap[0][1] or told[heap[0][1]] != kind or met[heap[0][1]].get(key) != heap[0][0]):
                heappop(heap)
            if heap and (best is None or heap[0] < best):
                best = heap[0]
        return best and best[1]

    for place, (me, key) in enumerate(steps):
        if often[key] < 2:
            continue
        g = find(me)
        place = met[g].pop(key, place)  # not to be found itself
        while (other := first_fit(g, key)) is not None:
            place = min(place, met[other].pop(key))
            g, other = (g, other) if len(met[g]) >= len(met[other]) else (other, g)
            root[other], lowest[g] = g, min(lowest[g], lowest.pop(other))
            more, into = met.pop(other), met[g]
            fresh = [k for k, at in more.items() if at < into.get(k, at + 1)]
            into.update((k, more[k]) for k in fresh)
            if told[g] | told[other] != told[g]:
                told[g] |= told[other]
                held[g] = tuple(y if x is None else x for x, y in zip(held[g], held[other]))
                fresh = list(into)
            for k in fresh:
                enter(g, k)
        met[g][key] = place
        enter(g, key)
    return {x: lowest[find(x)] for x in held}


def _shared(own: tuple[str | None, ...], part: int) -> tuple[int, str | None, str | None, str | None]:
    """part, and the values at its bits."""
    return part, own[0] if part & 1 else None, own[1] if part & 2 else None, own[2] if part & 4 else None


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups of one component: records by id join the groups of their keys."""
    steps, held = [], {}
    for row in pdf.sort_values("id").to_dict("records"):
        own = [(n, row[n]) for n in IDENTITIES if isinstance(row[n], str)]
        held[row["id"]] = tuple(row[n] if isinstance(row[n], str) else None for n in EXCLUSIVE)
        steps += [(row["id"], key) for key in own]
    found = _united(steps, held)
    return pd.DataFrame({"id": list(found), "group_id": list(found.values())})


def _rank(key: str) -> int:
    return IDENTITIES.index(key.split(":", 1)[0])


def _replay_holders(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same for groups that holders (key, g, f, *EXCLUSIVE) have left open: (g, to), those that stay left out."""
    rows = sorted(pdf[["key", "g", "f", *EXCLUSIVE]].itertuples(index=False, name=None), key=lambda x: (x[2], _rank(x[0])))
    held = {g: tuple(v if isinstance(v, str) else None for v in own) for _, g, _, *own in rows}
    found = {g: to for g, to in _united([(g, key) for key, g, *_ in rows], held).items() if g != to}
    return pd.DataFrame({"g": list(found), "to": list(found.values())}, dtype="int64")


def _lowest_links(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """Of one key's holders (f, *EXCLUSIVE) in order, the places of those that fit another one, with the lowest link: (later f, earlier f).

    Two holders fit unless an identifier that both have differs. Holders are looked up by the values that they share with each
    pattern of missing identifiers, so the work is linear in the holders.
    """
    told = [tuple(n for n, v in enumerate(row[1:]) if isinstance(v, str)) for row in rows]

    def fits(order: range, first: bool) -> Iterator[tuple[int, list[int]]]:
        """Each holder that fits others before it in order, with the first or last of these for each pattern."""
        at: dict[tuple, int] = {}
        met: set[tuple[int, ...]] = set()
        for i in order:
            mine, values = told[i], rows[i][1:]
            shared = {other: tuple(n for n in mine if n in other) for other in met}
            found = [at.get((other, both, tuple(values[n] for n in both))) for other, both in shared.items()]
            if any(x is not None for x in found):
                yield i, [x for x in found if x is not None]
            met.add(mine)
            for k in range(len(mine) + 1):
                for both in combinations(mine, k):
                    place = (mine, both, tuple(values[n] for n in both))
                    if not first or place not in at:
                        at[place] = i

    links = {i: (rows[i][0], rows[min(others)][0]) for i, others in fits(range(len(rows)), True)}
    for i, others in fits(range(len(rows) - 1, -1, -1), False):
        links.setdefault(i, (rows[min(others)][0], rows[i][0]))
    return links


LIVING = "key string, g bigint, f bigint, later bigint, rank int, earlier bigint"
#: With partners: the other group of the link, whether it has all that this one holds, and what this one holds.
PARTNERS = LIVING + ", to bigint, within boolean, " + ", ".join(f"{n} string" for n in EXCLUSIVE)


def _living(batches: Iterable[pd.DataFrame], partners: bool = False) -> Iterator[pd.DataFrame]:
    """Holders (key, g, f, *EXCLUSIVE), sorted by key and f, with their lowest links; those without one are left out."""
    names = [x.split()[0] for x in (PARTNERS if partners else LIVING).split(", ")]
    key, held, out = None, [], []

    def close() -> None:
        if len(held) < 2:
            return
        rank, links = _rank(key), _lowest_links([x[1:] for x in held])
        by_record = {x[1]: x for x in held} if partners else {}
        for i, (later, earlier) in links.items():
            g, f, *own = held[i]
            row = (key, g, f, later, rank, earlier)
            if partners:
                to, _, *other = by_record[earlier if f == later else later]
                row += (to, all(not isinstance(x, str) or isinstance(y, str) for x, y in zip(own, other)), *own)
            out.append(row)

    for pdf in batches:
        for row in pdf[["key", "g", "f", *EXCLUSIVE]].itertuples(index=False, name=None):
            if row[0] != key:
                close()
                key, held = row[0], []
            held.append(row[1:])
        if out:
            yield pd.DataFrame(out, columns=names)
            out.clear()
    close()
    if out:
        yield pd.DataFrame(out, columns=names)


def _followed(living: DataFrame) -> DataFrame:
    """(g, to) of the groups that may follow their lowest link at once, and of the pairs that agree on it."""
    lowest = living.groupBy("g").agg(F.min(F.struct("later", "rank", "earlier", "to", "within")).alias("link"))
    lowest = materialize(lowest.select("g", "link.*"), "identity-lowest")
    pairs = lowest.groupBy("later", "rank", "earlier").agg(F.min("g").alias("u"), F.max("g").alias("v"), F.count("*").alias("n")).where("n = 2").select("u", "v")
    edges = lowest.where("within").select(F.col("g").alias("u"), F.col("to").alias("v")).unionByName(pairs)
    return materialize(components(edges, alone=TASK_EDGES).select(F.col("node").alias("g"), F.col("component_id").alias("to")), "identity-moves")


def _settled(living: DataFrame, task_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(g, to) of living components that can be united or replayed as a whole, and the holders of the others; None if none can be."""
    first = materialize(living.groupBy("key").agg(F.min("g").alias("v")), "identity-keys")
    linked = components(hot_join(living.select("key", "g"), first, "key").select(F.col("g").alias("u"), "v"), alone=TASK_EDGES)
    placed = hot_join(living.select("key", "g", "f", *EXCLUSIVE), linked.select(F.col("node").alias("g"), F.col("component_id").alias("root")), "g")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "g")), "identity-placed")
    plain = reduce(Column.__and__, [F.min(x).eqNullSafe(F.max(x)) for x in EXCLUSIVE])
    verdict = materialize(placed.groupBy("root").agg(plain.alias("plain"), F.count("*").alias("n")), "identity-verdict")
    few = verdict.where(~F.col("plain") & (F.col("n") <= task_rows))
    settled = few.unionByName(verdict.where("plain")).select("root")
    if settled.isEmpty():
        return None
    replayed = placed.join(few, "root", "left_semi").groupBy("root").applyInPandas(lambda pdf: _replay_holders(pdf), "g bigint, to bigint")
    whole = placed.where("g <> root").join(verdict.where("plain"), "root", "left_semi").select("g", F.col("root").alias("to")).distinct()
    moves = materialize(whole.unionByName(replayed), "identity-moves")
    return moves, materialize(placed.join(settled, "root", "left_anti").select("key", "g", "f", *EXCLUSIVE), "identity-open")


def groups_in_rounds(rows: DataFrame, task_rows: int, max_rounds: int = 10_000) -> DataFrame:
    """(id, group_id) of distinct (id, *IDENTITIES), as _replay gives them, without a task that takes a component.

    A link of two groups is a key that both hold; its place in the order is the record that tries it, the key's rank and the
    record that is tried. Links of groups that clash are dead for good, as groups only grow. Each round finds the lowest living
    link of every group. It is followed at once by a group of which the other side has all exclusive identifiers already: whatever
    comes before can only add to that side, so they will fit, and what it brings changes nothing for others, as all that still fits
    the other side fits it too and has a later link with it. So all that a frequent key unites come together in one round. Of the
    others, pairs for which the lowest link is the same one unite: nothing that comes before can change either side. The lowest
    link of all is such a pair, so rounds end. A round waits only where a group may get or bring a new exclusive identifier, which
    happens to it three times at most.

    Every fourth round, and once few holders are left, living components in which nothing can clash are united as a whole, and
    those of at most task_rows living holders are replayed, each in one task. Where no component can be, the round follows links
    like any other. Only groups that still have a living link are kept. A task of a round takes the groups that hold one key, a
    row each.
    """
    held = [F.min(n).alias(n) for n in EXCLUSIVE]
    state = keys(rows).withColumnsRenamed({"id": "g"}).join(rows.select(F.col("id").alias("g"), *EXCLUSIVE), "g").withColumn("f", F.col("g"))
    joined: list[DataFrame] = []
    for n in range(1, max_rounds + 1):
        living = materialize(state.repartition("key").sortWithinPartitions("key", "f").mapInPandas(lambda x: _living(x, True), PARTNERS), "identity-living")
        left = living.count()
        if not left:
            break
        done = _settled(living, task_rows) if n % 4 == 0 or left <= task_rows else None
        moves, living = done or (_followed(living), living)
        joined.append(moves)
        moved = hot_join(living.select("key", "g", "f", *EXCLUSIVE), moves, "g").withColumn("g", F.coalesce("to", "g")).drop("to")
        moved = materialize(moved, "identity-moved")
        state = hot_join(moved.groupBy("key", "g").agg(F.min("f").alias("f")), moved.groupBy("g").agg(*held), "g")
    else:
        raise RuntimeError(f"groups have not settled in {max_rounds} rounds")
    if not joined:
        return rows.select("id", F.col("id").alias("group_id"))
    found = components(reduce(DataFrame.unionByName, joined).select(F.col("g").alias("u"), F.col("to").alias("v")), alone=TASK_EDGES)
    return rows.select("id").join(found.withColumnsRenamed({"node": "id", "component_id": "group_id"}), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def duplicate_groups(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, group_id) for every row of (id, *IDENTITIES); group_id is the group's smallest id.

    Records of equal identities are one from the start, so copies cost nothing. A component without two values of an exclusive
    identifier is a group. Only where there are two does the order of records matter: components of at most task_rows distinct
    identities are replayed, each in one task, larger ones are settled in rounds over all tasks. Both give the same groups.
    Records without an identity are groups of their own. An empty table gives no rows.
    """
    ident = F.when(F.coalesce(*IDENTITIES).isNotNull(), F.sha2(F.to_json(F.struct(*IDENTITIES)), 256))
    given = materialize(rows.select("id", ident.alias("ident"), *IDENTITIES), "identity-rows")
    distinct = materialize(given.where("ident IS NOT NULL").groupBy("ident").agg(F.min("id").alias("id"), *[F.min(n).alias(n) for n in IDENTITIES]), "identities")
    linked = components(candidate_links(distinct).select(F.col("left").alias("u"), F.col("right").alias("v"))).select(F.col("node").alias("id"), F.col("component_id").alias("root"))
    rooted = materialize(distinct.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id")), "identity-roots")
    one = [F.min(n).eqNullSafe(F.max(n)) for n in EXCLUSIVE]
    mixed = materialize(rooted.groupBy("root").agg(reduce(Column.__and__, one).alias("plain"), F.count("*").alias("n")).where("NOT plain").select("root", "n"), "identity-mixed")
    within = rooted.join(mixed.where(F.col("n") <= task_rows), "root", "left_semi").select("root", "id", *IDENTITIES)
    replayed = within.groupBy("root").applyInPandas(lambda pdf: _replay(pdf), "id bigint, group_id bigint")
    large = mixed.where(F.col("n") > task_rows)
    if not large.isEmpty():
        beyond = materialize(rooted.join(large, "root", "left_semi").select("id", *IDENTITIES), "identity-large")
        replayed = replayed.unionByName(groups_in_rounds(beyond, task_rows))
    grouped = rooted.join(mixed, "root", "left_anti").select("id", F.col("root").alias("group_id")).unionByName(replayed)
    named = materialize(distinct.select("ident", "id").join(grouped, "id").select("ident", "group_id"), "identity-groups")
    return hot_join(given.select("id", "ident"), named, "ident").select("id", F.coalesce("group_id", "id").alias("group_id"))


def merge_by_key(rows: DataFrame, key: str, ordinal: str, fields: list[str]) -> DataFrame:
    """One record a key: each field from the first row that has it."""
    return rows.groupBy(key).agg(*[_first(F.col(f), ordinal).alias(f) for f in fields], F.count("*").alias("n"))


def _first(value: Column, ordinal: str, among: Column | None = None) -> Column:
    """The value of the lowest ordinal that isn't null or empty."""
    real = value.isNotNull() & (value.cast("string") != "")
    return F.min(F.when(real if among is None else real & among, F.struct(F.col(ordinal).alias("o"), value.alias("v"))))["v"]


def _waiting(open_: DataFrame, name: str, at: str) -> DataFrame:
    """open_ with at: -1 if no record holds name before this one, the other record if two hold it, else -2."""
    held = open_.groupBy(name).agg(F.min("ord").alias("__first"), F.count("*").alias("__n"))
    before = F.when(F.col("ord") == F.col("__first"), -1).when(F.col("__n") == 2, F.col("__first")).otherwise(-2)
    return hot_join(open_, held, name).withColumn(at, before.cast("bigint")).drop("__first", "__n")


def founders(rows: DataFrame, names: Sequence[str] = ("key", "title"), max_rounds: int = 10_000) -> DataFrame:
    """(ord, founder) for (ord, *names): in order, a record joins the record that founded its first name, or else its second, or
    founds a record of its own. A joined record's own names found nothing, so the relation isn't transitive.

    Rounds settle who founds. A record that comes first under both names does; one that waits for a single other founds if that one
    doesn't, so along chains of these the answer follows from the chain's end and its length, found by doubling pointers. All
    that share a name with a founder are open no more. A chain of n takes log n steps; only records that wait for several others
    take further rounds, and max_rounds guards against a fault. Names are never null, ords not negative.
    """
    a, b = names
    given = materialize(rows.select("ord", *names), "merge-rows")
    open_, found, rounds = materialize(given.groupBy(a, b).agg(F.min("ord").alias("ord")), "merge-open"), [], 0
    while not open_.isEmpty():
        both = _waiting(materialize(_waiting(open_, a, "at_a"), "merge-waiting"), b, "at_b")
        alone = (F.col("at_a") >= 0) & (F.col("at_b") == -1) | (F.col("at_b") >= 0) & (F.col("at_a") == -1)
        chain = materialize(both.select("ord", a, b, F.when(alone, F.greatest("at_a", "at_b")).otherwise(F.col("ord")).alias("to"), alone.alias("odd"), ((F.col("at_a") == -1) & (F.col("at_b") == -1)).alias("sure")), "merge-chain")
        moving = not chain.where("odd").isEmpty()
        rounds += 1
        while moving:
            rounds += 1
            step = chain.select(F.col("ord").alias("to"), F.col("to").alias("far"), F.col("odd").alias("more"), F.col("sure").alias("known"))
            chain = materialize(hot_join(chain, step, "to").select("ord", a, b, F.col("far").alias("to"), (F.col("odd") != F.col("more")).alias("odd"), (F.col("sure") | F.col("known")).alias("sure"), (F.col("far") != F.col("to")).alias("moved")), "merge-chain")
            moving = not chain.where("moved").isEmpty()
        now = chain.where("sure AND NOT odd").select("ord", a, b)
        left = materialize(hot_join(open_, now.select(a, F.col("ord").alias("via_a")), a).where("via_a IS NULL").select("ord", a, b), "merge-open")
        open_ = materialize(hot_join(left, now.select(b, F.col("ord").alias("via_b")), b).where("via_b IS NULL").select("ord", a, b), "merge-open")
        found.append(now)
        if rounds > max_rounds:
            raise RuntimeError(f"founders have not settled in {max_rounds} rounds")
    if not found:
        return given.select("ord", F.col("ord").alias("founder"))
    all_ = reduce(DataFrame.unionByName, found)
    named = materialize(hot_join(given, all_.select(a, F.col("ord").alias("via_a")), a), "merge-named")
    both = hot_join(named, all_.select(b, F.col("ord").alias("via_b")), b)
    return both.select("ord", F.when(F.col("via_a") <= F.col("ord"), F.col("via_a")).otherwise(F.col("via_b")).alias("founder"))


def merge_records(rows: DataFrame, fields: Sequence[str] = ("venue",)) -> DataFrame:
    """(ord, key, title, publication_date, date_source, *fields) -> (first_ord, key, title, publication_date, date_source, *fields,
    n), a record for each founder. Each field comes from the first record that has it; of dates the first to the day wins over
    coarser ones and brings its source. An empty table gives no rows.
    """
    held = materialize(rows.join(founders(rows), "ord"), "merge-held")
    day = F.length("publication_date") == 10
    dated = held.groupBy("founder").agg(F.min(F.when(day, F.struct("ord", F.col("publication_date").alias("date"), F.col("date_source").alias("source")))).alias("exact"), F.min(F.when(F.col("publication_date") != "", F.col("ord"))).alias("dated_at"))
    known = hot_join(held, dated, "founder")
    # an exact date that takes the place of a coarser one brings its source along, or else the next one that is known
    swapped = F.col("exact.ord") > F.col("dated_at")
    after = F.coalesce(F.col("ord") > F.col("exact.ord"), F.lit(False))
    merged = known.groupBy("founder").agg(
        *[F.min(F.when(F.col("ord") == F.col("founder"), F.col(n))).alias(n) for n in ("key", "title")],
        F.coalesce(F.first("exact")["date"], _first(F.col("publication_date"), "ord")).alias("publication_date"),
        F.when(F.first(swapped), F.coalesce(F.nullif(F.first("exact")["source"], F.lit("")), _first(F.col("date_source"), "ord", after))).otherwise(_first(F.col("date_source"), "ord")).alias("date_source"),
        *[_first(F.col(f), "ord").alias(f) for f in fields],
        F.count("*").alias("n"),
    )
    return merged.withColumnRenamed("founder", "first_ord")

import random

from corpusloom.operators import incremental as I

WAL = "source_key string, wal_sequence bigint, file_path string, content_hash string, received_ms bigint, generation string"
CHECK = "run_id bigint, generation bigint, source_key string, status string, total_files bigint, processed_files bigint, updated_unix_ms bigint"
SEG = "generation bigint, source_key string, wal_range struct<first_sequence: bigint, last_sequence: bigint>"


def brute(wal, check, seg):
    newest = {}
    for r in check:
        if r[0] is not None and (r[0] not in newest or r[6] > newest[r[0]][6]):
            newest[r[0]] = r
    runs = [(r[2], s[2][0], s[2][1], r[6]) for r in newest.values() for s in seg if r[3] == "completed" and r[4] == r[5] and r[1] is not None and s[0] == r[1] and s[1] == r[2]]
    first = {}
    for s, q, p, h, t, _ in wal:
        if s is not None and q is not None:
            a = first.get((s, q))
            first[s, q] = (p, h, t if a is None or a[2] is None or t is not None and t < a[2] else a[2])
    out = set()
    for (s, q), (p, h, t) in first.items():
        if any(g[0] == s and g[1] <= q <= g[2] and t is not None and t <= g[3] for g in runs):
            continue
        before = [x for x in first if x[0] == s and x[1] < q and first[x][0] == p and p is not None]
        if before and h is not None and first[max(before)][1] == h:
            continue
        out.add((s, q))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    wal, check, seg = [], [], []
    for s in ("a", "b", None):
        for q in range(1, 120):
            if r.random() < 0.85:
                row = (s, q + (1 << 16) * (q > 60), r.choice(["x", "y", None]), r.choice(["h1", "h2", None]), r.choice([q * 10, q * 10 + 300, None]), "clash")
                wal += [row] * r.choice([1, 1, 2])
        for g in range(25):
            lo = r.randrange(1, 110)
            lo += (1 << 16) * (lo > 60)
            check += [(len(check) + 100 * g, g, s, r.choice(["completed", "completed", "failed"]), 3, r.choice([3, 3, 2]), r.randrange(0, 1500))]
            seg += [(g, s, (lo, lo + r.randrange(0, 40)))] * 2
    wal.append(("a", None, "x", "h", 1, ""))
    args = (spark.createDataFrame(wal, WAL), spark.createDataFrame(check, CHECK), spark.createDataFrame(seg, SEG))
    got = [(x.source_key, x.wal_sequence) for x in I.next_batch(*args).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(wal, check, seg)
    first = I.first_deliveries(args[0])
    done = I.ledger(first, I.successful_runs(args[1], args[2]))
    low = I.low_water(first, done)
    assert {(x.source_key, x.wal_sequence) for x in I.pending(first, done, low).collect()} == set(got)


def test_empty_tables(spark):
    e = [spark.createDataFrame([], x) for x in (WAL, CHECK, SEG)]
    assert I.next_batch(*e).count() == 0
    one = spark.createDataFrame([("s", 1, "p", None, 5, "")], WAL)
    assert I.next_batch(one, e[1], e[2]).count() == 1

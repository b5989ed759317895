"""Slices across functions against a walk in plain Python."""

import random

from corvane.operators import crossing


def program(rng, n_fn, n_stmt):
    names = [f"v{k}" for k in range(5)]
    some = lambda most: sorted(set(rng.choices(names, k=rng.randint(0, most))))
    stmts = {(f, i): (some(2), some(3)) for f in range(n_fn) for i in range(n_stmt)}
    params = {(f, k): names[k] for f in range(n_fn) for k in range(rng.randint(0, 3))}
    calls = {(f, i, rng.randrange(n_fn)): [some(2) for _ in range(rng.randint(0, 3))] for (f, i) in stmts if rng.random() < 0.3}
    returns = {(f, rng.randrange(n_stmt)) for f in range(n_fn) for _ in range(rng.randint(0, 2))}
    return stmts, params, calls, returns


def walk(prog, origin, hops):
    stmts, params, calls, returns = prog
    seen, fresh = {(*origin, -1): 0}, [(*origin, -1)]
    for hop in range(1, hops + 1):
        after = []
        for f, i, pos in fresh:
            needs = stmts[f, i][1] if pos < 0 else {x for (g, j, _), args in calls.items() if (g, j) == (f, i) and pos < len(args) for x in args[pos]}
            for name in needs:
                after += [(f, j, -1) for j in range(i) if name in stmts[f, j][0]]
                for (g, k), p in params.items():
                    if g == f and p == name:
                        after += [(h, j, k) for (h, j, callee), args in calls.items() if callee == f and k < len(args) and args[k]]
            if pos < 0:
                after += [(g, r, -1) for (h, j, callee) in calls if (h, j) == (f, i) for g, r in returns if g == callee]
        fresh = [x for x in dict.fromkeys(after) if x not in seen]
        seen |= {x: hop for x in fresh}
    out = {}
    for (f, i, _), hop in seen.items():
        out[f, i] = min(hop, out.get((f, i), hop))
    return {(f, i, h) for (f, i), h in out.items()}


def test_cross_slices_equal_a_walk(spark):
    rng = random.Random(11)
    for size in ((3, 6), (5, 4)):
        prog = stmts, params, calls, returns = program(rng, *size)
        df = lambda rows, kind: spark.createDataFrame(list(rows), kind)
        tables = (
            df([(f, i, x) for (f, i), (_, r) in stmts.items() for x in r], "fn int, at int, name string"),
            df([(f, i, x) for (f, i), (w, _) in stmts.items() for x in w], "fn int, at int, name string"),
            df([(f, k, x) for (f, k), x in params.items()], "fn int, pos int, name string"),
            df(calls, "fn int, at int, callee int"),
            df([(f, i, g, k, x) for (f, i, g), args in calls.items() for k, a in enumerate(args) for x in a], "fn int, at int, callee int, pos int, name string"),
            df(returns, "fn int, at int"),
        )
        origins = [(q, q % size[0], size[1] - 1 - q // size[0]) for q in range(2 * size[0])]
        for hops in (1, 12):
            got = crossing.backward(df(origins, "q int, fn int, at int"), *tables, max_hops=hops).collect()
            for q, f, i in origins:
                assert {(r["fn"], r["at"], r["hop"]) for r in got if r["q"] == q} == walk(prog, (f, i), hops), (size, hops, q)

"""DuckDB forms of the checked operators (the oracle side of ``__spark_entry__.oracle_sql``).

Each helper returns common table expressions as (name, sql) pairs so a check can chain them.
"""

from __future__ import annotations

from tabml.sources.views import SQL_VIEWS


def compose(main: str, views: tuple[str, ...] = (), ctes: list[tuple[str, str]] | None = None) -> str:
    parts = [(n, SQL_VIEWS[n]) for n in views] + list(ctes or [])
    if not parts:
        return main
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + main


def split_ctes(src: str, key: str, label: str | None) -> list[tuple[str, str]]:
    """md5 order, ceil(0.2 n) test rows (float product), train side by largest remainder."""
    grp = label if label else "0"
    return [
        ("sp_base", f"SELECT *, {grp} AS __grp, md5(CAST({key} AS VARCHAR) || ':42') AS __h FROM {src}"),
        ("sp_cnt", "SELECT __grp, count(*) AS c FROM sp_base GROUP BY __grp"),
        ("sp_tot", "SELECT sum(c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(c)) AS BIGINT) AS n_test FROM sp_cnt"),
        ("sp_alloc", "SELECT __grp, c, ((n - n_test) * c) // n AS tr, ((n - n_test) * c) % n AS rem, n, n_test "
                     "FROM sp_cnt, sp_tot"),
        ("sp_rank", "SELECT *, row_number() OVER (ORDER BY rem DESC, CAST(__grp AS VARCHAR)) AS rr, "
                    "(n - n_test) - sum(tr) OVER () AS leftover FROM sp_alloc"),
        ("sp_quota", "SELECT __grp, c - (tr + CASE WHEN rr <= leftover THEN 1 ELSE 0 END) AS q FROM sp_rank"),
        ("sp", f"SELECT b.*, row_number() OVER (PARTITION BY b.__grp ORDER BY b.__h, b.{key}) <= q.q AS is_test "
               f"FROM sp_base b JOIN sp_quota q USING (__grp)"),
    ]


def folds_sql(src: str, key: str, label: str | None, folds: int = 3) -> str:
    grp = f"{label}, " if label else ""
    return (f"SELECT *, CAST((row_number() OVER (ORDER BY {grp}md5(CAST({key} AS VARCHAR) || ':42'), {key}) - 1) "
            f"% {folds} AS INTEGER) AS fold FROM {src}")


def corr_expr(x: str, y: str) -> str:
    """|r| rounded to 4; undefined -> 0 (DuckDB gives NaN or NULL for a constant column)."""
    r = f"corr({x}, {y})"
    return f"CASE WHEN {r} IS NULL OR isnan({r}) THEN CAST(0 AS DOUBLE) ELSE round(abs({r}), 4) END"


def date_part_exprs(c: str) -> list[tuple[str, str]]:
    return [(f"{c}__year", f"CAST(year({c}) AS DOUBLE)"),
            (f"{c}__month", f"CAST(month({c}) AS DOUBLE)"),
            (f"{c}__day_of_week", f"CAST(isodow({c}) - 1 AS DOUBLE)"),
            (f"{c}__is_weekend", f"CAST(coalesce(isodow({c}) - 1 >= 5, false) AS DOUBLE)")]


def dummy_expr(c: str, v: str) -> str:
    return f"CAST(coalesce({c} = '{v}', false) AS DOUBLE)"


def candidates(numeric: list[str], per_column: list[tuple[str, str, list[str] | None]]):
    """Candidate list in the reference's order: [(name, sql expr, source, kind)].

    ``per_column``: (column, class, vocabulary) in frame order for bool / datetime / categorical."""
    out = [(c, f"CAST({c} AS DOUBLE)", c, "numeric") for c in numeric]
    for c, cls, vocab in per_column:
        if cls == "bool":
            out.append((c, f"CAST(CAST({c} AS INTEGER) AS DOUBLE)", c, "bool"))
        elif cls == "datetime":
            out += [(n, e, c, "datetime_part") for n, e in date_part_exprs(c)]
        elif cls == "categorical" and vocab is not None:
            out += [(f"{c}_{v}", dummy_expr(c, v), c, "onehot") for v in vocab]
    return out


def decisions_sql(src: str, target: str, numeric: list[str], per_column: list[tuple[str, str, list[str] | None]],
                  where: str = "TRUE") -> str:
    """M1's feature table over ``src`` rows matching ``where``: whole-column rows first (frame order),
    then candidates with rounded |r| and decision, then the interaction of the top two kept."""
    cands = candidates(numeric, per_column)
    head = []
    for c, cls, vocab in per_column:
        if cls == "datetime":
            head.append((c, c, "datetime_raw", "decomposed"))
        elif cls == "categorical":
            head.append((c, c, "categorical", "one_hot" if vocab is not None else "dropped_high_cardinality"))
        elif cls == "other":
            head.append((c, c, "other", "dropped_type"))
    y = f"CAST({target} AS DOUBLE)"
    x_proj = ", ".join(f'{e} AS "x{i}"' for i, (_, e, _, _) in enumerate(cands))
    stats = ", ".join(f'{corr_expr(chr(34) + "x" + str(i) + chr(34), "__y")} AS "r{i}", var_samp("x{i}") AS "v{i}"'
                      for i in range(len(cands)))
    rows = []
    for i, (c, src_col, kind, dec) in enumerate(head):
        rows.append(f"SELECT {i} AS position, '{c}' AS feature, '{src_col}' AS source_column, '{kind}' AS kind, "
                    f"CAST(NULL AS DOUBLE) AS corr, '{dec}' AS decision")
    off = len(head)
    for i, (name, _, src_col, kind) in enumerate(cands):
        dec = (f"CASE WHEN v{i} IS NOT NULL AND v{i} < 1e-8 THEN 'dropped_low_variance' "
               f"WHEN r{i} < 0.01 THEN 'dropped_low_signal' WHEN r{i} >= 0.98 THEN 'kept_leakage_warning' "
               f"ELSE 'kept' END")
        rows.append(f"SELECT {off + i} AS position, '{name}' AS feature, '{src_col}' AS source_column, "
                    f"'{kind}' AS kind, r{i} AS corr, {dec} AS decision FROM st")
    body = " UNION ALL ".join(rows)
    n_all = off + len(cands)
    return compose(
        f"""SELECT * FROM dec UNION ALL
SELECT {n_all} AS position, max(CASE WHEN rk = 1 THEN feature END) || '__x__' || max(CASE WHEN rk = 2 THEN feature END),
       max(CASE WHEN rk = 1 THEN feature END) || ',' || max(CASE WHEN rk = 2 THEN feature END),
       'interaction', CAST(NULL AS DOUBLE), 'kept'
FROM (SELECT feature, row_number() OVER (ORDER BY corr DESC, position) AS rk FROM dec
      WHERE decision IN ('kept', 'kept_leakage_warning')) t HAVING count(*) >= 2""",
        ctes=[("xs", f"SELECT {y} AS __y, {x_proj} FROM {src} WHERE {where}"),
              ("st", f"SELECT {stats} FROM xs"),
              ("dec", body)])


def macro_prf_sql(src: str, actual: str, pred: str, group: str | None = None) -> list[tuple[str, str]]:
    """A19 per group: cells -> per-label tp / actual / predicted totals over the label union."""
    g = f"{group}, " if group else ""
    gj = f"l.{group} = x.{group} AND " if group else ""
    return [
        ("mc", f"SELECT {g}{actual} AS a, {pred} AS p, count(*) AS n FROM {src} GROUP BY ALL"),
        ("ml", f"SELECT DISTINCT {g}lbl FROM (SELECT {g}a AS lbl FROM mc UNION ALL SELECT {g}p FROM mc) u "
               f"WHERE lbl IS NOT NULL"),
        ("mp", f"""SELECT l.*, coalesce((SELECT sum(n) FROM mc x WHERE {gj}x.a = l.lbl AND x.p = l.lbl), 0) AS tp,
                  coalesce((SELECT sum(n) FROM mc x WHERE {gj}x.a = l.lbl), 0) AS n_actual,
                  coalesce((SELECT sum(n) FROM mc x WHERE {gj}x.p = l.lbl), 0) AS n_pred FROM ml l"""),
        ("mprf", f"""SELECT {g}avg(CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END) AS precision,
                    avg(CASE WHEN n_actual = 0 THEN 0 ELSE tp / n_actual END) AS recall,
                    avg(CASE WHEN n_actual + n_pred = 0 THEN 0 ELSE 2 * tp / (n_actual + n_pred) END) AS f1
                    FROM mp GROUP BY ALL"""),
    ]


def features_long_sql(src: str, key: str, extra: list[str], numeric: list[str],
                      per_column: list[tuple[str, str, list[str] | None]], decisions: str = "fd"
                      ) -> tuple[list[tuple[str, str]], str]:
    """M2 replay in long form: (row_key, extra..., feature, value) for every kept candidate of the
    decision table plus the interaction product of its top two. Returns (ctes, main select)."""
    cands = candidates(numeric, per_column)
    ex = "".join(f"{c}, " for c in extra)
    long = " UNION ALL ".join(f"SELECT {key} AS row_key, {ex}'{n}' AS feature, {e} AS value FROM {src}"
                              for n, e, _, _ in cands)
    ctes = [("lg", long),
            ("kept", f"SELECT feature FROM {decisions} WHERE decision IN ('kept', 'kept_leakage_warning')"),
            ("inter", f"SELECT feature, split_part(source_column, ',', 1) AS a, split_part(source_column, ',', 2) AS b "
                      f"FROM {decisions} WHERE kind = 'interaction'")]
    main = (f"SELECT lg.* FROM lg JOIN kept USING (feature) UNION ALL "
            f"SELECT x.row_key, {''.join(f'x.{c}, ' for c in extra)}i.feature, x.value * y.value AS value "
            f"FROM inter i JOIN lg x ON x.feature = i.a JOIN lg y ON y.feature = i.b AND y.row_key = x.row_key")
    return ctes, main

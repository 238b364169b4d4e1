"""DuckDB SQL fragments shared by the oracle statements.

They spell out, in plain SQL, the same rules the Spark functions implement,
from the same fixed values (keyword buckets, class rules)."""

from __future__ import annotations

from qcorpus.functions.scoring import (AGGREGATE_WORDS, AGGREGATION_FORBIDDEN, BUCKETS,
                                       keyword_pattern)
from qcorpus.plans import fixtures


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean_sql(expr: str) -> str:
    s = f"upper(coalesce({expr}, ''))"
    s = f"regexp_replace({s}, '`[^`]*`', '', 'g')"
    s = f"regexp_replace({s}, '''[^'']*''', '', 'g')"
    return f"regexp_replace({s}, '\"[^\"]*\"', '', 'g')"


def kw_count(clean: str, kw: str) -> str:
    return f"cast(len(regexp_extract_all({clean}, {q(keyword_pattern(kw))})) as bigint)"


def kw_alias(bucket: str, kw: str) -> str:
    return f"k_{bucket}_{kw.replace(' ', '_').lower()}"


def kw_columns(clean: str) -> str:
    """One count column per keyword of every bucket."""
    return ",\n  ".join(f"{kw_count(clean, kw)} as {kw_alias(b, kw)}"
                        for b, kws in BUCKETS.items() for kw in kws)


def bucket_sum(bucket: str) -> str:
    return "(" + " + ".join(kw_alias(bucket, kw) for kw in BUCKETS[bucket]) + ")"


def hits_string(bucket: str) -> str:
    parts = ", ".join(f"case when {kw_alias(bucket, kw)} > 0 then concat({q(kw + ':')}, "
                      f"cast({kw_alias(bucket, kw)} as varchar)) end" for kw in BUCKETS[bucket])
    return f"concat_ws(',', {parts})"


def weighted(bucket_weights=BUCKETS) -> str:
    return "(" + " + ".join(f"{kw_alias(b, kw)} * {w}" for b, kws in bucket_weights.items()
                            for kw, w in kws.items()) + ")"


def reward(f1="b1", f3="b3", f4="b4") -> str:
    tot = f"cast(({f1} + {f3} + {f4}) as double)"
    terms = " + ".join(f"cast({f} as double) * (cast({f} as double) / {tot})" for f in (f1, f3, f4))
    return f"case when ({f1} + {f3} + {f4}) > 0 then {terms} else 0.0 end"


def difficulty(f1="b1", f3="b3", f4="b4") -> str:
    return (f"case when {f1} > 0 and {f3} > 0 and {f4} > 0 then 'complex' "
            f"when {f1} > 0 and {f4} > 0 then 'aggregation' "
            f"when {f1} > 0 and {f3} > 0 then 'conditional' "
            f"when {f1} > 0 then 'simple' end")


def present(f1="b1", f3="b3", f4="b4") -> str:
    return (f"concat_ws(',', case when {f1} > 0 then 'B1' end, case when {f3} > 0 then 'B3' end, "
            f"case when {f4} > 0 then 'B4' end)")


def pure_aggregation(clean: str) -> str:
    alt = "|".join(AGGREGATION_FORBIDDEN)
    return f"not regexp_matches({clean}, {q(chr(92) + 'b(' + alt + ')' + chr(92) + 'b')})"


def scored_corpus_ctes() -> str:
    """CTEs ``sql_corpus``, ``sc_clean``, ``sc_k`` (keyword counts) and
    ``scored`` (b1, b3, b4, total_hits, reward, difficulty, ...)."""
    return f"""
sql_corpus as ({fixtures.SQL_CORPUS_SQL}),
sc_clean as (select *, {clean_sql('sql')} as sql_clean from sql_corpus),
sc_k as (select *,
  {kw_columns('sql_clean')}
  from sc_clean),
sc_f as (select *, {bucket_sum('B1')} as b1, {bucket_sum('B3')} as b3, {bucket_sum('B4')} as b4 from sc_k),
scored as (select *, b1 + b3 + b4 as total_hits, {reward()} as reward, {difficulty()} as difficulty,
  {present()} as buckets_present from sc_f)"""


def forbidden_list(sql_expr: str, target: str, strict_compat: bool = False) -> str:
    """B10 in SQL, as a comma-joined string in the fixed word order."""
    s = f"upper(coalesce({sql_expr}, ''))"
    s = f"regexp_replace({s}, '''[^'']*''', '', 'g')"
    s = f"regexp_replace({s}, '\"[^\"]*\"', '', 'g')"
    agg = ", ".join(f"case when regexp_matches({s}, {q(keyword_pattern(w))}) then {q(w)} end"
                    for w in AGGREGATION_FORBIDDEN)
    words = [w for w in AGGREGATE_WORDS if not (strict_compat and " " in w)]
    simp = ", ".join(
        f"case when regexp_matches({s}, {q(chr(92) + 'b' + w.replace(' ', chr(92) + 's+') + chr(92) + 'b')}) "
        f"then {q(w)} end" for w in words)
    return (f"case when {target} = 'aggregation' then concat_ws(',', {agg}) "
            f"when {target} in ('simple', 'conditional') then concat_ws(',', {simp}) else '' end")

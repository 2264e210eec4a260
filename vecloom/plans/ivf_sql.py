"""The semantics of the IVF operators in DuckDB SQL, over long rows (vector, dimension, value).

These statements are the oracles of the catalogue's index queries, which run operators.index. The
partition is the table's label, the centroid its mean; the rotation is a sign-flipped Hadamard matrix
that both sides compute (catalog.hadamard).
"""

from __future__ import annotations

import re

STEPS = {
    "e": "select vec_id, label, unnest(range(len(embedding))) as d, cast(unnest(embedding) as double) as v from embeddings",
    "c": "select label, d, avg(v) as m from e group by label, d",
    "r": "select e.vec_id, e.label, e.d, e.v - c.m as r from e join c on e.label = c.label and e.d = c.d",
    "rot": "select a.x as i, b.x as j, case when bit_count(a.x & b.x) % 2 = 0 then 0.125 else -0.125 end * case when (7 * b.x * b.x + 3 * b.x + 1) % 5 < 2 then -1 else 1 end as w from (select cast(range as int) as x from range(64)) a cross join (select cast(range as int) as x from range(64)) b",
    "o": "select r.vec_id, r.label, rot.i, sum(rot.w * r.r) as o from r join rot on rot.j = r.d group by r.vec_id, r.label, rot.i",
    "rn": "select vec_id, sqrt(sum(r * r)) as rn from r group by vec_id",
    "x": "select o.vec_id, o.label, rn.rn, sum(abs(o.o)) / rn.rn as doo, sum(case when o.o >= 0 then 1 else 0 end) as positive from o join rn on o.vec_id = rn.vec_id group by o.vec_id, o.label, rn.rn",
    "s": "select label, d, min(r) as lo, max(r) as hi, case when max(r) - min(r) > 1e-8 then 255 / (max(r) - min(r)) else 1 end as sc from r group by label, d",
    "k": "select r.vec_id, r.label, r.d, floor(round(least(greatest((r.r - s.lo) * s.sc, 0), 255), 6)) as code from r join s on r.label = s.label and r.d = s.d",
    "q": "select d, v as q from e where vec_id = 3",
    "qr": "select c.label, c.d, q.q - c.m as qr from c join q on c.d = q.d",
    "pr": "select label, qd from (select label, round(sum(qr * qr), 6) as qd, row_number() over (order by round(sum(qr * qr), 6), label) as rk from qr group by label) where rk <= 4",
    "qo": "select qr.label, rot.i, sum(rot.w * qr.qr) as qo from qr join rot on rot.j = qr.d join pr on pr.label = qr.label group by qr.label, rot.i",
    "qs": "select label, sum(abs(qo)) / 64 as sabs, sqrt(sum(qo * qo)) / 64 as snorm, min(qo) as lo, max(qo) as hi from qo group by label",
    "ip": """select o.vec_id, o.label, sum(case when o.o >= 0 then qo.qo else -qo.qo end) as ip, sum(case when (o.o >= 0) = (qo.qo >= 0) then 1 else -1 end) as same, min(qs.sabs) as sabs, min(qs.snorm) as snorm,
      sum(case when o.o >= 0 then 1 else -1 end * (qs.lo + floor(round((qo.qo - qs.lo) / ((qs.hi - qs.lo) / 255), 6)) * ((qs.hi - qs.lo) / 255))) as ip8,
      sum(case when o.o >= 0 then 1 else -1 end * (qs.lo + floor(round((qo.qo - qs.lo) / ((qs.hi - qs.lo) / 15), 6)) * ((qs.hi - qs.lo) / 15))) as ip4
      from o join qo on o.label = qo.label and o.i = qo.i join qs on qs.label = o.label group by o.vec_id, o.label""",
    "sc": "select ip.vec_id, ip.label, {SCORE} as score from ip join x on ip.vec_id = x.vec_id join pr on pr.label = ip.label",
    "cand": "select vec_id, label, score from (select *, row_number() over (order by round(score, 6), vec_id) as rk from sc) where rk <= {KEEP}",
    "fine": "select cand.vec_id, round(sum((qr.qr - (s.lo + k.code / s.sc)) * (qr.qr - (s.lo + k.code / s.sc))), 4) as dist from cand join k on k.vec_id = cand.vec_id join s on s.label = k.label and s.d = k.d join qr on qr.label = k.label and qr.d = k.d group by cand.vec_id",
    "dist": "select e.vec_id, c.label as cand_label, round(sum((e.v - c.m) * (e.v - c.m)), 6) as dist from e join c on e.d = c.d group by e.vec_id, c.label",
    "sup": "select cast(label as int) % 3 as super_id, d, avg(m) as m from c group by cast(label as int) % 3, d",
    "sdist": "select e.vec_id, sup.super_id, round(sum((e.v - sup.m) * (e.v - sup.m)), 6) as dist from e join sup on e.d = sup.d group by e.vec_id, sup.super_id",
    "near": "select vec_id, cand_label as part from (select *, row_number() over (partition by vec_id order by dist, cand_label) as rk from dist) where rk = 1",
    "truth": "select qid, vec_id, rank from (select a.vec_id as qid, b.vec_id, row_number() over (partition by a.vec_id order by round(sum((a.v - b.v) * (a.v - b.v)), 6), b.vec_id) as rank from e a join e b on a.d = b.d where a.vec_id % 50 = 0 group by a.vec_id, b.vec_id) where rank <= 10",
}

ESTIMATE = "x.rn * x.rn + pr.qd - 2 * x.rn * ({}) / greatest(x.doo, 1e-8)"
SCORES = {"std": ESTIMATE.format("ip.ip"), "fastscan": ESTIMATE.format("ip.same * ip.sabs"), "fastscan_compat": ESTIMATE.format("ip.same * ip.snorm"), "qq8": ESTIMATE.format("ip.ip8"), "qq4": ESTIMATE.format("ip.ip4")}


def rounded(x: str) -> str:
    """Four decimals, never minus zero."""
    return f"case when round({x}, 4) = 0 then 0.0 else round({x}, 4) end"


def _top(name: str) -> tuple[str, dict]:
    return f"select vec_id, label, {rounded('score')} as score from sc order by round(score, 4), vec_id limit 10", {"SCORE": SCORES[name]}


FINAL: dict[str, tuple[str, dict]] = {
    "ivf_centroids": (f"select label, d, {rounded('m')} as m from c", {}),
    "ivf_assign": ("select vec_id, part from near", {}),
    "ivf_assign_two_level": ("""select vec_id, cand_label as part from (select dist.*, row_number() over (partition by dist.vec_id order by dist.dist, dist.cand_label) as rk from dist
      join (select vec_id, super_id from (select *, row_number() over (partition by vec_id order by dist, super_id) as rk from sdist) where rk <= 2) t on t.vec_id = dist.vec_id and t.super_id = cast(dist.cand_label as int) % 3) where rk = 1""", {}),
    "lloyd_step": (f"select near.part, e.d, {rounded('avg(e.v)')} as m from e join near on e.vec_id = near.vec_id group by near.part, e.d", {}),
    "ivf_balance": ("select min(n) as least, max(n) as most, cast(sum(n) as bigint) as total from (select part, count(*) as n from near group by part)", {}),
    "ivf_probe": ("select label, round(qd, 4) as qd from pr", {}),
    "ivf_probe_two_level": ("""select label, round(qd, 4) as qd from (select label, round(sum(qr * qr), 6) as qd, row_number() over (order by round(sum(qr * qr), 6), label) as rk from qr where cast(label as int) % 3 in
      (select super_id from (select super_id, row_number() over (order by round(sum((q.q - sup.m) * (q.q - sup.m)), 6), super_id) as rk from sup join q on q.d = sup.d group by super_id) where rk <= 2) group by label) where rk <= 2""", {}),
    "ivf_flat_search": ("select e.vec_id, round(sum((e.v - q.q) * (e.v - q.q)), 4) as dist from e join q on e.d = q.d where e.label in (select label from pr) group by e.vec_id order by round(sum((e.v - q.q) * (e.v - q.q)), 4), e.vec_id limit 10", {}),
    "rabitq_encode": ("select vec_id, cast(positive as bigint) as positive, round(rn, 4) as residual_norm, round(doo, 4) as dot_o_bar_o from x", {}),
    **{f"rabitq_search_{n}": _top(n) for n in SCORES},
    "sq8_stats": (f"select label, d, {rounded('lo')} as lo, {rounded('hi')} as hi from s", {}),
    "sq8_encode": ("select vec_id, cast(sum(code) as bigint) as code_sum from k group by vec_id", {}),
    "sq8_refine": ("select vec_id, dist from fine order by dist, vec_id", {"SCORE": SCORES["std"], "KEEP": "50"}),
    "two_stage_search": ("select vec_id, dist from fine order by dist, vec_id limit 10", {"SCORE": SCORES["fastscan"], "KEEP": "100"}),
    "sq8_dynamic_distance": ("select k.vec_id, round(sum((qr.qr - (s.lo + k.code / s.sc)) * (qr.qr - (s.lo + k.code / s.sc))), 4) as dist from k join s on s.label = k.label and s.d = k.d join qr on qr.label = k.label and qr.d = k.d group by k.vec_id", {}),
    "sq8_fixed_vs_dynamic_error": ("""select round(avg(abs(f.dist - t.dist)), 4) as fixed_error, round(avg(abs(y.dist - t.dist)), 4) as dynamic_error, count(*) as vectors from
      (select e.vec_id, sum((e.v - q.q) * (e.v - q.q)) as dist from e join q on q.d = e.d group by e.vec_id) t
      join (select e.vec_id, sum((q.q - (floor(round(least(greatest((e.v + 1) * 127.5, 0), 255), 6)) * (2 / 255.0::double) - 1)) * (q.q - (floor(round(least(greatest((e.v + 1) * 127.5, 0), 255), 6)) * (2 / 255.0::double) - 1))) as dist from e join q on q.d = e.d group by e.vec_id) f on f.vec_id = t.vec_id
      join (select k.vec_id, sum((qr.qr - (s.lo + k.code / s.sc)) * (qr.qr - (s.lo + k.code / s.sc))) as dist from k join s on s.label = k.label and s.d = k.d join qr on qr.label = k.label and qr.d = k.d group by k.vec_id) y on y.vec_id = t.vec_id""", {}),
    "recall_at_k": ("""select round(avg(hit), 4) as recall from (select t.qid, t.vec_id, case when n.part = m.part then cast(1 as double) else cast(0 as double) end as hit from truth t join near n on n.vec_id = t.vec_id join near m on m.vec_id = t.qid)""", {}),
    "distance_quality": ("""select round(corr(score, d), 4) as pearson, round(corr(rs, rd), 4) as spearman, round(avg(abs(score - d)), 4) as mae, count(*) as pairs from (select score, d, rank() over (order by round(score, 6)) as rs, rank() over (order by round(d, 6)) as rd from
      (select sc.vec_id, sc.score, sum((e.v - q.q) * (e.v - q.q)) as d from sc join e on e.vec_id = sc.vec_id join q on q.d = e.d group by sc.vec_id, sc.score))""", {"SCORE": SCORES["std"]}),
    "memory_per_vector": ("select round(cast(4 * 64 * 64 + count(distinct label) * (64 * 4 * 4 + 4) + 4 * 64 * 3 as double) / count(*) + 84, 4) as bytes_per_vector, round(256 / (cast(4 * 64 * 64 + count(distinct label) * (64 * 4 * 4 + 4) + 4 * 64 * 3 as double) / count(*) + 84), 4) as compression from embeddings", {}),
    "index_stats": ("select cast(64 as bigint) as dimension, count(distinct label) as num_partitions, count(*) as total_vectors from embeddings", {}),
    "export_metadata": ("select count(distinct label) as partitions, cast(max(len(embedding)) as bigint) as dimension, cast(sum(1) as bigint) as total from embeddings", {}),
}
#: What each step needs, besides what it names.
ORDER = list(STEPS)


def _needs(text: str, found: set[str]) -> set[str]:
    for step in ORDER:
        if step not in found and re.search(rf"\b(from|join)\s+{step}\b", text):
            found.add(step)
            _needs(STEPS[step], found)
    return found


def statement(name: str) -> str:
    """The query's SQL: the steps it needs as common table expressions, then its last select."""
    final, extra = FINAL[name]
    words = {"SCORE": "", "KEEP": ""} | extra
    needed = _needs(final, set())
    ctes = ", ".join(f"{s} as ({STEPS[s].format(**words)})" for s in ORDER if s in needed)
    return (f"with {ctes} " if ctes else "") + final.format(**words)

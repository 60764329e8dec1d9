"""The catalogue's queries in SQL, from named steps that each query picks its own chain of."""

from __future__ import annotations

import re

STEPS = {
    "ev": "select event_type symbol, epoch(ts) s, ts, value price from events where value > 0",
    "ev_d": "select symbol, cast(floor(s / 86400) * 86400 as bigint) t, arg_min(price, ts) o, max(price) h, min(price) l, arg_max(price, ts) c, cast(count(*) as double) v from ev group by 1, 2",
    "ev_6": "select symbol, cast(floor(s / 21600) * 21600 as bigint) t, arg_min(price, ts) o, max(price) h, min(price) l, arg_max(price, ts) c, cast(count(*) as double) v from ev group by 1, 2",
    "lv0": "select *, (h + l + c) / 3 pivot, (h + l) / 2 bc, 2 * (h + l + c) / 3 - (h + l) / 2 tc from ev_d",
    "lv": "select *, least(bc, tc) bottom, greatest(bc, tc) top, (greatest(bc, tc) - least(bc, tc)) / abs(pivot) width, 2 * pivot - l r1, pivot + h - l r2, h + 2 * (pivot - l) r3, 2 * pivot - h s1, pivot - (h - l) s2, l - 2 * (h - pivot) s3 from lv0",
    "trs": "select *, lag(c) over (partition by symbol order by t) pc from ev_d",
    "tr": "select *, case when pc is not null then greatest(h - l, abs(h - pc), abs(l - pc)) end tr from trs",
    "trl": "select *, list(tr) filter (where tr is not null) over (partition by symbol order by t rows between 138 preceding and current row) xs from tr",
    "atr": "select symbol, t, tr, case when len(xs) >= 14 then list_reduce(list_prepend(list_avg(xs[1:14]), xs[15:]), lambda a, x: (a * 13 + x) / 14) end atr from trl",
    "vr": "select symbol, t, ln(c / lag(c) over (partition by symbol order by t)) r from ev_d",
    "vol": "select symbol, t, case when count(r) over w = 20 then stddev_samp(r) over w * sqrt(365) end volatility from vr window w as (partition by symbol order by t rows between 19 preceding and current row)",
    "wl": "select symbol, t, width, list(width) over (partition by symbol order by t rows between 120 preceding and 1 preceding) ws from lv",
    "wp": "select symbol, t, case when len(ws) >= 20 then len(list_filter(ws, lambda x: x <= width)) / cast(len(ws) as double) end width_percentile from wl",
    "wr": "select *, case when width_percentile is null then 'unknown' when width_percentile <= 0.25 then 'tight' when width_percentile >= 0.75 then 'wide' else 'normal' end width_regime from wp",
    "day": "select lv.*, atr, volatility, width_percentile, width_regime from lv join atr using (symbol, t) join vol using (symbol, t) join wr using (symbol, t)",
    "ms": "select symbol, t, c price, " + ", ".join(f"lag({x}) over w {x}" for x in "pivot bottom top r1 r2 r3 s1 s2 s3 atr volatility width width_percentile width_regime".split()) + " from day window w as (partition by symbol order by t)",
    "mp": """select *, case when price > top then 'above_tc' when price < bottom then 'below_bc' else 'inside_cpr' end cpr_position,
        case when price > r3 then 'above_r3' when price > r2 then 'r2_r3' when price > r1 then 'r1_r2' when price > pivot then 'pivot_r1' when price >= s1 then 's1_pivot' when price >= s2 then 's2_s1' when price >= s3 then 's3_s2' else 'below_s3' end pivot_position from ms where pivot is not null""",
    # --- relative strength ---
    "al": "select a.symbol, a.t, a.c, b.c b, v.c s from ev_6 a join ev_6 b on a.t = b.t and b.symbol = 'click' left join ev_6 v on v.t = a.t and v.symbol = 'view' and a.symbol <> 'view' where a.symbol <> 'click'",
    "rt": "select *, case when t - lag(t) over w = 21600 then ln(c / lag(c) over w) end rc, case when t - lag(t) over w = 21600 then ln(b / lag(b) over w) end rb, case when t - lag(t) over w = 21600 then ln(s / lag(s) over w) end rs from al window w as (partition by symbol order by t)",
    "rn": "select *, sum(case when rc is null then 1 else 0 end) over (partition by symbol order by t) run from rt",
    "rk": "select *, row_number() over (partition by symbol, run order by t) k from rn where rc is not null",
    "ex": "select a.symbol, a.t, least(a.k, 120) n, a.k - b.k j, b.rc, b.rb, b.rs, pow(0.5, (a.k - b.k) / 28.0) w0 from rk a join rk b on a.symbol = b.symbol and a.run = b.run and b.k between a.k - 119 and a.k where a.k >= 88",
    "ew": "select *, w0 / sum(w0) over (partition by symbol, t) w from ex",
    "m1": "select symbol, t, median(rc) ma, median(rb) mb, median(rs) ms from ew group by 1, 2",
    "m2": "select symbol, t, any_value(ma) ma, any_value(mb) mb, any_value(ms) ms, 1.4826 * median(abs(rc - ma)) sa, 1.4826 * median(abs(rb - mb)) sb, 1.4826 * median(abs(rs - ms)) ss from ew join m1 using (symbol, t) group by 1, 2",
    "cut": "select ew.*, greatest(ma - 6 * sa, least(rc, ma + 6 * sa)) y, greatest(mb - 6 * sb, least(rb, mb + 6 * sb)) x, case when rs is not null then greatest(ms - 6 * ss, least(rs, ms + 6 * ss)) end q from ew join m2 using (symbol, t)",
    "mo": "select *, sum(w * y) over g my, sum(w * x) over g mx, sum(w * q) over g mq from cut window g as (partition by symbol, t)",
    "fit": "select symbol, t, any_value(n) n, any_value(my) my, any_value(mx) mx, sum(w * (x - mx) * (x - mx)) vx, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) beta, sum(w * (x - mx) * (q - mq)) / sum(w * (x - mx) * (x - mx)) g, 1 / sum(w * w) n_eff from mo group by 1, 2",
    "re": "select mo.*, beta, my0 - beta * mx0 alpha, vx, n_eff, rc - (my0 - beta * mx0) - beta * rb e, rc - beta * rb r from mo join (select symbol, t, my my0, mx mx0, vx, beta, n_eff from fit) f using (symbol, t)",
    "e1": "select symbol, t, median(e) me from re group by 1, 2",
    "e2": "select symbol, t, any_value(me) me, 1.4826 * median(abs(e - me)) se from re join e1 using (symbol, t) group by 1, 2",
    "e3": "select re.*, greatest(me - 6 * se, least(e, me + 6 * se)) ec from re join e2 using (symbol, t)",
    "e4": "select *, sum(w * ec) over g mec, sum(w * rc) over g mr from e3 window g as (partition by symbol, t)",
    "fd0": "select symbol, t, any_value(beta) beta, any_value(alpha) alpha, any_value(vx) vx, any_value(n_eff) n_eff, sum(w * (ec - mec) * (ec - mec)) ve, sum(w * (rc - mr) * (rc - mr)) vt, sum(w * e * e) vr from e4 group by 1, 2",
    "fd": "select *, sqrt(ve) residual_volatility, greatest(0, least(1, 1 - vr / vt)) r_squared, sqrt(ve / (n_eff * vx)) beta_error from fd0",
    "hs": "select symbol, t, j, n, unnest([{'name': 'short', 'h': 1, 'v': r}, {'name': 'medium', 'h': 4, 'v': sum(r) over (partition by symbol, t order by j desc rows between 3 preceding and current row)}, {'name': 'long', 'h': 28, 'v': sum(r) over (partition by symbol, t order by j desc rows between 27 preceding and current row)}]) z from re",
    "hv": "select symbol, t, z.name as name, j, z.v v from hs where n - j >= z.h",
    "hc": "select symbol, t, name, max(case when j = 0 then v end) cur, median(v) filter (where j > 0) m from hv group by 1, 2, 3",
    "hz": "select symbol, t, name, any_value(cur) cur, any_value(cur) / (1.4826 * median(abs(v - m)) filter (where j > 0)) z, (count(*) filter (where j > 0 and v < cur) + 0.5 * count(*) filter (where j > 0 and v = cur)) / count(*) filter (where j > 0) pct from hv join hc using (symbol, t, name) group by 1, 2, 3",
    "hp": "select symbol, t, " + ", ".join(f"max(case when name = '{n}' then {v} end) {k}_{n}" for n in ("short", "medium", "long") for k, v in (("z", "z"), ("sum", "cur"), ("pct", "pct"))) + " from hz group by 1, 2",
    "pa": "select symbol, t, sum(sign(r)) filter (where j < 4) / 4.0 persistence, (avg(r) filter (where j < 1) - avg(r) filter (where j between 1 and 3)) / (any_value(residual_volatility) * sqrt(1 + 1 / 3.0)) acceleration from re join (select symbol, t, residual_volatility from fd) f using (symbol, t) group by 1, 2",
    "nm": "select *, greatest(-1, least(1, z_short / 3)) a, greatest(-1, least(1, z_medium / 3)) b, greatest(-1, least(1, z_long / 3)) c, greatest(-1, least(1, acceleration / 3)) d from hp join pa using (symbol, t)",
    "sc": "select *, 10 * (0.15 * a + 0.35 * b + 0.3 * c + 0.15 * persistence + 0.05 * d) raw_score, 10 * (0.15 * a + 0.35 * b + 0.3 * c + 0.05 * d) / 0.85 raw_discovery from nm",
    # --- two factors ---
    "zz": "select mo.*, rs - g * rb z, y - my yc, x - mx xc from mo join (select symbol, t, g from fit) f using (symbol, t) where symbol <> 'view'",
    "z1": "select symbol, t, median(z) mz from zz group by 1, 2",
    "z2": "select symbol, t, any_value(mz) mz, 1.4826 * median(abs(z - mz)) sz from zz join z1 using (symbol, t) group by 1, 2",
    "z3": "select zz.*, greatest(mz - 6 * sz, least(z, mz + 6 * sz)) zw from zz join z2 using (symbol, t)",
    "z4": "select *, sum(w * zw) over (partition by symbol, t) mzw from z3",
    "z5": "select symbol, t, any_value(my) my0, any_value(mx) mx0, any_value(mzw) mz0, sum(w * xc * xc) vx, sum(w * (zw - mzw) * (zw - mzw)) vz, sum(w * xc * (zw - mzw)) cxz, sum(w * xc * yc) cxy, sum(w * yc * (zw - mzw)) czy, 1 / sum(w * w) n_eff from z4 group by 1, 2",
    "z6": "select *, vx * vz - cxz * cxz det, (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz) b1, (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) b2 from z5",
    "z7": "select z4.symbol, z4.t, w, rc, rc - (my0 - b1 * mx0 - b2 * mz0) - b1 * rb - b2 * z e from z4 join z6 using (symbol, t)",
    "z8": "select symbol, t, median(e) me from z7 group by 1, 2",
    "z9": "select symbol, t, any_value(me) me, 1.4826 * median(abs(e - me)) se from z7 join z8 using (symbol, t) group by 1, 2",
    "za": "select z7.*, greatest(me - 6 * se, least(e, me + 6 * se)) ec from z7 join z9 using (symbol, t)",
    "zb": "select *, sum(w * ec) over g mec, sum(w * rc) over g mr from za window g as (partition by symbol, t)",
    "zc": "select symbol, t, sum(w * (ec - mec) * (ec - mec)) ve, sum(w * (rc - mr) * (rc - mr)) vt, sum(w * e * e) vr from zb group by 1, 2",
    "two": """select symbol, t, b1 beta, b2 beta_2, my0 - b1 * mx0 - b2 * mz0 alpha, greatest(0, least(1, 1 - vr / vt)) r_squared, sqrt(ve * vz / (n_eff * det)) beta_error, sqrt(ve * vx / (n_eff * det)) beta_2_error, g g_beta
        from z6 join zc using (symbol, t) join (select symbol, t, g from fit) f using (symbol, t)
        union all select symbol, t, beta, null, alpha, r_squared, beta_error, null, null from fd where symbol = 'view'""",
    # --- weekly cross-section ---
    "wk": "select p_brand symbol, cast(floor((epoch(l_shipdate) - 345600) / 604800) * 604800 + 345600 as bigint) t, sum(l_extendedprice) / sum(l_quantity) c, sum(l_quantity) v from lineitem join part on l_partkey = p_partkey group by 1, 2",
    "wc": "select *, case when t - lag(t) over w = 604800 then ln(c / lag(c) over w) end r from wk window w as (partition by symbol order by t)",
    "ws": "select symbol, t, round(r, 3) score from wc",
    "lo0": "select symbol, t, r, count(r) over (partition by t) - (case when r is not null then 1 else 0 end) others, sum(r) over (partition by t) - coalesce(r, 0) rest from (select * from wc where symbol <> 'Brand#11') x",
    "lo": "select symbol, t, others, case when others >= 20 then rest / others end f from lo0",
    "lo2": "select *, sum(case when f is null or t - pt <> 604800 then 1 else 0 end) over (partition by symbol order by t) seg from (select *, lag(t) over (partition by symbol order by t) pt from lo) x",
    # --- decisions ---
    "sn": """select sc.*, round(raw_score, 2) score, round(raw_discovery, 2) discovery, p.c price, p.pc prior, lv.pivot, lv.top, lv.bottom, lv.r1, lv.s1,
        case when p.c > lv.top and p.c > lv.pivot then 'LONG' when p.c < lv.bottom and p.c < lv.pivot then 'SHORT' else 'NONE' end side
        from sc join (select symbol, t, c, lag(c) over (partition by symbol order by t) pc from ev_6) p using (symbol, t) left join lv on lv.symbol = sc.symbol and lv.t + 86400 = cast(floor((sc.t + 21600) / 86400) * 86400 as bigint)""",
    "st": """select *, case when pivot is null then 'i' when score >= 3.5 and persistence >= 0.4 and side = 'LONG' then 'cl' when score <= -3.5 and persistence <= -0.4 and side = 'SHORT' then 'cs' when score >= 3.5 then 'wl' when score <= -3.5 then 'ws'
        when abs(discovery) >= 3 then 'sd' when abs(discovery) >= 2.5 then 'ed' else 'n' end k, coalesce(prior <= r1 and price > r1, false) up, coalesce(prior >= s1 and price < s1, false) down from sn""",
    "se": """select symbol, t, case k when 'i' then 'INSUFFICIENT_DATA' when 'cl' then 'LONG_CANDIDATE' when 'cs' then 'SHORT_CANDIDATE' when 'n' then 'NEUTRAL' else 'WATCH' end label,
        case when k in ('i', 'n') then 'NONE' when k in ('cl', 'wl') then 'LONG' when k in ('cs', 'ws') then 'SHORT' when discovery > 0 then 'LONG' else 'SHORT' end direction,
        case when k = 'i' then 0.0 when k in ('cl', 'cs', 'wl', 'ws') then least(100, abs(score) * 10 + case when k = 'cl' and up or k = 'cs' and down then 10 else 0 end) else least(100, abs(discovery) * 10) end strength,
        case when k in ('cl', 'cs') then 'CONFIRMED' end confirmation, case when k in ('cl', 'cs', 'wl', 'ws') then 'CANDIDATE_GRADE' when k = 'sd' then 'STRONG_DISCOVERY' when k = 'ed' then 'EARLY_DISCOVERY' end tier,
        case k when 'cl' then 'persistent beta-adjusted strength; completed bar closed above TC; completed bar closed above daily pivot' || case when up then '; fresh completed close above R1' else '' end
          when 'cs' then 'persistent beta-adjusted weakness; completed bar closed below BC; completed bar closed below daily pivot' || case when down then '; fresh completed close below S1' else '' end
          when 'wl' then 'strong RS' when 'ws' then 'weak RS' when 'sd' then 'strong persistence-free RS discovery' when 'ed' then 'early persistence-free RS discovery' else '' end reasons,
        case k when 'wl' then concat_ws('; ', case when persistence < 0.4 then 'persistence has not cleared the long threshold' end, case when side <> 'LONG' then 'neither current mid nor completed close has bullish structure' end)
          when 'ws' then concat_ws('; ', case when persistence > -0.4 then 'persistence has not cleared the short threshold' end, case when side <> 'SHORT' then 'neither current mid nor completed close has bearish structure' end)
          when 'sd' then 'confirmed candidate score has not cleared 3.5' when 'ed' then 'confirmed candidate score has not cleared 3.5' when 'n' then 'discovery score is below the early threshold' else '' end blockers,
        k, score, discovery, side, pivot, sum_medium, z_medium, (rank() over (partition by t order by sum_medium) - 1 + (count(*) over (partition by t, sum_medium) - 1) / 2.0) / nullif(count(*) over (partition by t) - 1, 0) mom from st""",
    "tg0": """select 'confirmed_candidate' as rule, symbol, t, pivot is not null eligible, case when k in ('cl', 'cs') then label end state, direction, score from se
        union all select 'early_discovery', symbol, t, true, case when abs(discovery) >= 2.5 then 'early_discovery' end, case when discovery > 0 then 'LONG' else 'SHORT' end, discovery from se
        union all select 'strong_discovery', symbol, t, true, case when abs(discovery) >= 3 then 'strong_discovery' end, case when discovery > 0 then 'LONG' else 'SHORT' end, discovery from se
        union all select 'h5_discovery_structure', symbol, t, pivot is not null, case when abs(discovery) >= 3 and side = case when discovery > 0 then 'LONG' else 'SHORT' end then 'h5_discovery_structure' end, case when discovery > 0 then 'LONG' else 'SHORT' end, discovery from se
        union all select 'residual_momentum_baseline', symbol, t, true, case when mom >= 0.8 and sum_medium > 0 or mom <= 0.2 and sum_medium < 0 then 'residual_momentum_baseline' end, case when sum_medium > 0 then 'LONG' else 'SHORT' end, z_medium from se""",
    "tg": "select rule, symbol, t, eligible, state, case when state is not null then direction end direction, case when state is not null then score end trigger_score from tg0",
    "tk0": "select *, state || '|' || direction now, lag(state || '|' || direction) over (partition by rule, symbol order by t) before from tg where eligible",
    "tk": "select *, case when before is null then case when t = (select min(u.t) from tk0 u where u.rule = tk0.rule and u.now is not null) then 'seeded' else 'activated' end when now is null then 'cleared' else 'changed' end kind from tk0 where now is distinct from before",
    "as0": "select symbol, t, z_medium, case when abs(z_medium) >= 1 then case when z_medium > 0 then 'LONG' else 'SHORT' end end direction, beta from hp join (select symbol, t, beta from fd) f using (symbol, t)",
    "as1": "select *, lag(direction) over (partition by symbol order by t) before from as0",
    "ac": "select 'residual_scale' as rule, symbol, t + 21600 t, case when before is null then 'activated' else 'changed' end kind, direction, z_medium trigger_score, beta from as1 where direction is distinct from before and direction is not null",
    "px": "select symbol, t + 21600 t, c from ev_6",
    "oc": """select a.symbol, a.t, a.direction, h.horizon, a.t + h.horizon * 21600 exit_t, x.c / e.c - 1 + 0 * be.c * bx.c gross, ln(x.c / e.c) - a.beta * ln(bx.c / be.c) adjusted, case when e.c is null or x.c is null or be.c is null or bx.c is null then 'missing_forward_price' end missing
        from ac a cross join (values (1), (4)) h(horizon) left join px e on e.symbol = a.symbol and e.t = a.t left join px x on x.symbol = a.symbol and x.t = a.t + h.horizon * 21600 left join px be on be.symbol = 'click' and be.t = a.t left join px bx on bx.symbol = 'click' and bx.t = a.t + h.horizon * 21600""",
    "fu": """select oc.*, case when exit_t <= (select max(t) from ev_6) and oc.t >= (select min(t) from ev_6) then (case when direction = 'SHORT' then -1 else 1 end) * (select case when count(*) = oc.horizon then sum((v % 7 - 3) / 10000) end from ev_6 e where e.symbol = oc.symbol and e.t > oc.t and e.t <= oc.exit_t) end funding from oc""",
    "ne": "select *, (case when direction = 'SHORT' then -gross else gross end) - 0.001 - funding net from fu",
    # --- gates on a panel with gaps ---
    "gp": "select * from ev_6 where not (symbol = 'view' and (t // 21600) % 11 = 3) and not (symbol = 'purchase' and t > (select max(t) from ev_6) - 216000) and not (symbol = 'click' and (t // 21600) % 53 = 5)",
    "gb": "select t, row_number() over (order by t) ib, min(t) over () b0 from gp where symbol = 'click'",
    "gn": "select g.symbol, g.t, min(g.t) over (partition by g.symbol) a0, sum(case when g.t >= (select min(t) from gb) then 1 else 0 end) over (partition by g.symbol order by g.t) na from gp g where symbol <> 'click'",
    "gm": "select gn.symbol, t, na, ib, a0, b0, row_number() over (partition by gn.symbol order by t) ic, case when t - lag(t) over (partition by gn.symbol order by t) = 21600 then 0 else 1 end brk from gn join gb using (t)",
    "gr0": "select *, sum(brk) over (partition by symbol order by t) run, ic / cast(greatest(1, (t - greatest(a0, b0)) // 21600 + 1, na, ib - (select count(*) from gb x where x.t < gm.a0)) as double) ratio from gm",
    "gr": "select *, least(row_number() over (partition by symbol, run order by t) - 1, 120) + 1 bars from gr0",
    "dg": "select * from ev_d where not (symbol = 'view' and (t // 86400) % 9 = 4) and not (symbol = 'purchase' and t > (select max(t) from ev_d) - 259200)",
    "dq": "select symbol, t, h, l, c, row_number() over w n, max(case when t - pt <> 86400 then 1 else 0 end) over w gap from (select *, lag(t) over (partition by symbol order by t) pt from dg) x window w as (partition by symbol order by t)",
    "dt": "select q.symbol, q.a as_of, d.t dt, d.n, d.gap, (d.h + d.l + d.c) / 3 pivot from (select symbol, t + 21600 a from ev_6) q asof left join (select *, t + 86400 a from dq) d on q.symbol = d.symbol and q.a >= d.a",
    # --- contexts, universe and outcomes of the model ---
    "cx": "select symbol, max(t) lt, arg_max(c, t) mid from ev_6 group by 1",
    "tb": "select symbol, median(v * (h + l + c) / 3) base from (select *, row_number() over (partition by symbol order by t desc) n from ev_d) x where n <= 20 and v > 0 group by 1",
    "mk": "select p_brand as name, p_brand like '%5' delisted, round(sum(p_retailprice), 2) notional from part group by 1, 2",
    "mo2": """select a.symbol, a.t, h.horizon, a.direction, ln(x.c / e.c) - w.beta * ln(bx.c / be.c) adj, w.beta_2, w.g_beta, ln(bx.c / be.c) mb, ln(sx.c / se.c) ms, x.c / e.c - 1 + 0 * be.c * bx.c gross
        from ac a join two w on w.symbol = a.symbol and w.t + 21600 = a.t cross join (values (1), (4)) h(horizon) left join px e on e.symbol = a.symbol and e.t = a.t left join px x on x.symbol = a.symbol and x.t = a.t + h.horizon * 21600
        left join px be on be.symbol = 'click' and be.t = a.t left join px bx on bx.symbol = 'click' and bx.t = a.t + h.horizon * 21600 left join px se on se.symbol = 'view' and se.t = a.t left join px sx on sx.symbol = 'view' and sx.t = a.t + h.horizon * 21600""",
    "pr": "select symbol, t, case when t - lag(t) over w = 21600 then ln(c / lag(c) over w) end r from px window w as (partition by symbol order by t)",
    "bf": """select a.symbol, a.t, h.horizon, count(*) filter (where m.t is not null) steps, sum(m.mean) broad from ac a cross join (values (1), (4)) h(horizon) cross join lateral (select unnest(generate_series(1, h.horizon)) i) s
        left join lateral (select any_value(r.t) t, avg(r.r) mean from pr r where r.t = a.t + s.i * 21600 and r.symbol not in (a.symbol, 'click') and r.r is not null having count(*) >= 2) m on true group by 1, 2, 3""",
    "vb0": "select symbol, t, row_number() over (partition by symbol order by t) k, sum(c * v) over (partition by symbol order by t) s from ev_6",
    "vb": "select a.symbol, a.t, a.s - coalesce(b.s, 0) day_notional, (select median(x.s - coalesce(y.s, 0)) from generate_series(1, 20) i(i) join vb0 x on x.symbol = a.symbol and x.k = a.k - 4 * i left join vb0 y on y.symbol = a.symbol and y.k = a.k - 4 * i - 4 where a.k - 4 * i >= 4) base from vb0 a left join vb0 b on b.symbol = a.symbol and b.k = a.k - 4",
    "sp": """select r.*, case rule when 'confirmed_candidate' then 'H1' when 'strong_discovery' then 'D1' when 'h5_discovery_structure' then 'H5' when 'residual_momentum_baseline' then 'B1' end spec_id from tg r where rule <> 'early_discovery'""",
}
R = lambda *names: ", ".join(f"round({n}, 6) {n}" for n in names)
_METRICS = "count(net) n, count(*) - count(net) missing, round(avg(case when net is null then null when net > 0 then 1.0 else 0 end), 6) win_rate"
QUERIES = {
    "ohlcv_daily": f"select symbol, t, {R(*'ohlcv')} from ev_d",
    "ohlcv_6h": f"select symbol, t, {R(*'ohlcv')} from ev_6",
    "daily_rollup": f"select symbol, cast(t // 86400 * 86400 as bigint) t, round(arg_min(o, t), 6) o, round(max(h), 6) h, round(min(l), 6) l, round(arg_max(c, t), 6) c, round(sum(v), 6) v from ev_6 group by 1, 2 having count(*) = 4",
    "completed_bars": "select symbol, t, round(c, 6) c from ev_6 where t + 21600 <= (select max(t) from ev_6)",
    "bar_validity": "select event_type symbol, coalesce(isfinite(value) and value > 0, false) valid, count(*) n from events group by 1, 2",
    "cpr_levels": f"select symbol, t, {R('pivot', 'bc', 'tc', 'bottom', 'top', 'width')} from lv",
    "floor_pivots": f"select symbol, t, {R('pivot', 'r1', 'r2', 'r3', 's1', 's2', 's3')} from lv",
    "positions": "select symbol, t, cpr_position, pivot_position from mp",
    "wilder_atr": f"select symbol, t, {R('tr', 'atr')} from atr",
    "realized_vol": f"select symbol, t, {R('volatility')} from vol",
    "width_percentile_regime": f"select symbol, t, {R('width_percentile')}, width_regime from wr",
    "level_distance_atr": "select symbol, t, unnest(['pivot', 'r1', 'r2', 'r3', 's1', 's2', 's3']) as level, round(unnest([(price - x) / atr for x in [pivot, r1, r2, r3, s1, s2, s3]]), 6) distance from mp",
    "daily_quality_flags": """select symbol, concat_ws(',', case when n < 2 then 'insufficient_daily_history' end, case when last <> (select max(t) from ev_d) + 86400 then 'stale_daily_structure' end, case when gap then 'daily_history_gap' end) flags
        from (select symbol, count(*) n, max(t) as last, coalesce(bool_or(g <> 86400), false) gap from (select *, t - lag(t) over (partition by symbol order by t) g from ev_d) x group by 1) y""",
    "market_structure": f"select symbol, t, {R('pivot', 'bottom', 'top', 'r1', 's1', 'atr', 'volatility', 'width')}, width_regime, cpr_position, pivot_position from mp",
    "aligned_returns": f"select symbol, t, {R('rc', 'rb')} from rt",
    "contiguous_suffix": "select symbol, count(*) n, min(t) as first, max(t) as last from rn where run = (select max(run) from rn x where x.symbol = rn.symbol) group by 1",
    "alignment_ratio": """select symbol, common, expected, round(common / cast(greatest(1, expected, n, nb) as double), 6) ratio from (
        select a.symbol, count(b.t) common, count(*) n, any_value(f) f, (any_value(g) - any_value(f)) // 21600 + 1 expected, (select count(*) from ev_6 where symbol = 'click' and t between any_value(f) and any_value(g)) nb
        from (select * from ev_6 join (select symbol, greatest(min(t), (select min(t) from ev_6 where symbol = 'click')) f, least(max(t), (select max(t) from ev_6 where symbol = 'click')) g from ev_6 where symbol <> 'click' group by 1) s using (symbol) where t between f and g) a
        left join (select t from ev_6 where symbol = 'click') b using (t) group by 1) z""",
    "robust_scale": "select symbol, t, n, round(ma, 6) location, round(sa, 6) scale from m2 join (select symbol, t, any_value(n) n from ex group by 1, 2) x using (symbol, t)",
    "winsorized_returns": "select symbol, t, round(sum(greatest(ma - 2 * sa, least(rc, ma + 2 * sa))), 6) total, count(*) filter (where abs(rc - ma) > 2 * sa) n_cut from ew join m2 using (symbol, t) group by 1, 2",
    "ewma_weights": "select distinct n, n - 1 - j i, round(w, 9) weight from ew",
    "ols_beta": "select symbol, n, round(beta, 6) beta, round(alpha, 6) alpha, round(r2, 6) r_squared, round(sqrt(syy * (1 - r2) / (n - 2)), 6) residual_volatility, round(sqrt(syy * (1 - r2) / (n - 2)) / sqrt(sxx), 6) beta_error from (select symbol, count(*) n, regr_slope(rc, rb) beta, regr_intercept(rc, rb) alpha, regr_r2(rc, rb) r2, regr_sxx(rc, rb) sxx, regr_syy(rc, rb) syy from rt where rc is not null group by 1) x",
    "robust_beta_one_factor": f"select symbol, t, {R('beta', 'alpha', 'r_squared', 'residual_volatility', 'beta_error', 'n_eff')} from fd",
    "robust_beta_two_factor": f"select symbol, t, {R('beta', 'beta_2', 'alpha', 'r_squared', 'beta_error', 'beta_2_error', 'g_beta')} from two",
    "factor_residuals": "select symbol, t, n - 1 - j i, round(r, 6) residual from re",
    "horizon_robust_z": "select symbol, t, " + R(*(f"{k}_{h}" for h in ("short", "medium", "long") for k in ("z", "sum", "pct"))) + " from hp",
    "persistence_acceleration": f"select symbol, t, {R('persistence', 'acceleration')} from pa",
    "rs_score": f"select symbol, t, {R('raw_score', 'raw_discovery')} from sc",
    "loo_factor": "select symbol, t, others, round(f, 6) f from lo where f is not null",
    "loo_level": "select symbol, t, round(100 * exp(sum(coalesce(f, 0)) over w), 6) s, min(case when f is not null then others end) over w least_others from lo2 window w as (partition by symbol, seg order by t) qualify f is not null",
    "strength_rank": "select symbol, t, case when score is not null then row_number() over (partition by t, score is null order by score desc, symbol) end strong_rank, case when score is not null then row_number() over (partition by t, score is null order by score, symbol desc) end weak_rank from ws",
    "breadth": "select t, count(*) panel, count(*) usable, round(avg(case when round(raw_score, 2) > 0 then 1.0 else 0 end), 6) positive, round(avg(case when abs(round(raw_score, 2)) >= 3.5 then 1.0 else 0 end), 6) strong, round(median(round(raw_score, 2)), 6) median_score from sc group by 1",
    "breadth_weekly": "select t, count(*) panel, count(score) usable, round(avg(case when score is null then null when score > 0 then 1.0 else 0 end), 6) positive, round(avg(case when score is null then null when abs(score) >= 3.5 then 1.0 else 0 end), 6) strong, round(median(score), 6) median_score from ws group by 1",
    "residual_momentum_percentile": "select symbol, t, case when score is not null and count(score) over (partition by t) >= 2 then round((rank() over (partition by t, score is null order by score) - 1 + (count(*) over (partition by t, score) - 1) / 2.0) / (count(score) over (partition by t) - 1), 6) end percentile from ws",
    "volume_context": "select symbol, round(max(case when block = 0 then x end), 4) notional, round(max(case when block = 0 then x end) / median(case when block > 0 then x end), 6) relative from (select symbol, block, sum(c * v) x, count(*) n from (select *, (row_number() over (partition by symbol order by t desc) - 1) // 4 block from ev_6) y group by 1, 2 having block <= 20 and (count(*) = 4 or block = 0)) z group by 1",
    "universe_topk": "select symbol, t from wk qualify row_number() over (partition by t order by case when symbol in ('Brand#11', 'Brand#22') then 0 else 1 end, round(c * v, 2) desc, symbol) <= 8",
    "setup_label": "select symbol, t, label, direction, round(strength, 6) strength, confirmation, tier, reasons, blockers from se",
    "active_triggers": "select rule, symbol, t, eligible, state, direction, round(trigger_score, 6) trigger_score from tg",
    "archive_event_counts": "select rule, " + ", ".join(f"count(*) filter (where kind = '{k}') {k}" for k in ("seeded", "activated", "changed", "cleared")) + " from tk group by 1",
    "rule_transitions": "select rule, symbol, t, kind, direction, round(trigger_score, 6) trigger_score from ac",
    "forward_outcomes": "select symbol, t, direction, cast(horizon as bigint) horizon, round(gross, 6) gross, round(adjusted, 6) adjusted, missing from oc",
    "funding_cost": "select symbol, t, cast(horizon as bigint) horizon, direction, round(funding, 6) funding from fu",
    "net_event_metrics": f"""select cast(horizon as bigint) horizon, {_METRICS}, round(avg(net) filter (where net > 0), 6) average_win, round(avg(net) filter (where net < 0), 6) average_loss, round(avg(net), 6) expectancy,
        round(sum(net) filter (where net > 0) / -sum(net) filter (where net < 0), 6) profit_factor, round(avg(net) / stddev_samp(net), 6) mean_deviation_ratio, (select round(avg(m), 6) from (select t, avg(net) m from ne x where x.horizon = ne.horizon group by 1) y) time_mean from ne group by horizon""",
    "calendar_partition": """select cast(horizon as bigint) horizon, case when dev and t >= ts then 'test' when dev and exit_t < ts then 'train' when t >= hs and t <= b then 'holdout' else 'purged' end part, count(*) n
        from (select *, t >= a and t < hs and exit_t < hs dev from (select *, a + (hs - a) * 0.65 ts from (select oc.*, a, b, b - (b - a) * 0.2 hs from oc cross join (select min(t) a, max(t) + 21600 b from ev_6) p) q) r) s group by 1, 2""",
    "score_buckets": "select case when x < 0.5 then '0-0.5' when x < 1 then '0.5-1' when x < 2 then '1-2' else '>=2' end bucket, count(*) n from (select abs(round(z_medium, 6)) x from hp) y group by 1",
    "feature_buckets": "select case when x < -1 then '<-1' when x < 0 then '-1-0' when x < 1 then '0-1' else '>=1' end bucket, count(*) n from (select round(acceleration, 6) x from pa) y group by 1",
    "cohort_metrics": f"select cohort, value, {_METRICS}, round(avg(net), 6) expectancy from (select 'direction' cohort, direction as value, net from ne union all select 'symbol', symbol, net from ne) x group by 1, 2",
    "candle_version_asof": "select symbol, t, round(case when t // 86400 % 3 = 2 then round(c * 1.02, 4) else c end, 6) c from ev_d",
    "first_version_prices": "select symbol, t, round(c, 6) c from ev_d",
    "changed_versions": "select symbol, t, round(c + 1, 6) c, cast(2 as bigint) as scan from ev_d where symbol = 'click'",
    "replay_audit": "select rule, symbol, t, case symbol when 'view' then 'unexpected' else 'score' end mismatch from ac where symbol in ('view', 'purchase')",
    "gate_funnel": """select symbol, count(*) usable, count(*) filter (where abs(raw_score) >= 2) strength, count(*) filter (where abs(persistence) >= 0.4) persistence, count(*) filter (where abs(raw_score) >= 2 and abs(persistence) >= 0.4) "both",
    case when count(*) filter (where abs(raw_score) >= 2) <= count(*) filter (where abs(persistence) >= 0.4) then 'strength' else 'persistence' end binding from sc group by 1""",
    "json_context": "select event_type symbol, count(json_extract(props, '$.k')) n, round(avg(cast(json_extract(props, '$.k') as double)), 6) mean_k, round(max(cast(json_extract(props, '$.k') as double)), 6) max_k from events group by 1",
    "newest_bars": "select symbol, t, round(c, 6) c from ev_6 qualify row_number() over (partition by symbol order by t desc) <= 5",
    "merged_bars": "select symbol, t, round(case when symbol = 'click' then c + 2 else c end, 6) c, true verified from ev_6",
    "bars_stream": f"select symbol, t, {R(*'ohlcv')} from ev_d",
    "signal_stream": "select symbol, t, case when before is null then 'activated' when direction is null then 'cleared' else 'changed' end kind, direction state from as1 where direction is distinct from before",
    "usability_gates": "select symbol, t, bars, round(ratio, 6) ratio, case when ratio < 0.95 or bars < 89 then 1 else 0 end gates, case when bars < 89 then 'need 89 contiguous aligned bars; got ' || bars end reason, bars >= 89 and ratio >= 0.95 usable from gr",
    "stale_scan": """select symbol, t, (case when ratio < 0.95 then 1 else 0 end) + (case when t < (select max(t) from gp) then 1 else 0 end) + (case when bars < 89 and ratio >= 0.95 and t = (select max(t) from gp) then 1 else 0 end) gates,
        bars >= 89 and ratio >= 0.95 and t = (select max(t) from gp) usable from gr qualify row_number() over (partition by symbol order by t desc) = 1""",
    "daily_gates": """select symbol, as_of, case when n >= 2 then concat_ws(',', case when dt <> as_of // 86400 * 86400 - 86400 then 'stale_daily_structure' end, case when gap = 1 then 'daily_history_gap' end) else 'insufficient_daily_history' end flags, case when n >= 2 then round(pivot, 6) end pivot from dt""",
    "alert_states": "select symbol, t, label, direction, round(strength, 6) strength from se where k in ('cl', 'cs')",
    "filter_counts": """select t, f as filter, count(*) n from (select t, unnest(list_filter(['ALL', case when confirmation = 'CONFIRMED' then 'CONFIRMED' end, case when label = 'WATCH' and direction = 'LONG' then 'LONG_WATCH' end, case when label = 'WATCH' and direction = 'SHORT' then 'SHORT_WATCH' end,
        case when tier in ('EARLY_DISCOVERY', 'STRONG_DISCOVERY', 'CANDIDATE_GRADE') then tier end, label], lambda x: x is not null)) f from se) y where f <> 'FLAGGED' group by 1, 2""",
    "gate_verdicts": """select sn.symbol, sn.t, abs(score) >= 3.5 strength_ok, sign(persistence) = z.way and abs(persistence) >= 0.4 persistence_ok, case when z.way > 0 then side = 'LONG' else side = 'SHORT' end structure_ok
        from sn join (select symbol, t, case when direction = 'LONG' then 1 when direction = 'SHORT' then -1 when score >= 0 then 1 else -1 end way from se) z using (symbol, t)""",
    "board_funnel": """select t, count(*) scored, count(*) filter (where abs(score) >= 3.5) strength, count(*) filter (where abs(persistence) >= 0.4) persistence, count(*) filter (where pivot is not null and (price > top or price < bottom)) structure from sn group by 1""",
    "board_order": "select symbol, t, row_number() over (partition by t order by score desc, symbol) place from sn",
    "breadth_figures": """select t, count(*) usable_assets, round(avg(case when score > 0 then 1.0 else 0 end), 6) positive_rs_ratio, round(avg(case when abs(score) >= 3.5 then 1.0 else 0 end), 6) strong_rs_ratio, round(median(score), 6) median_rs_score,
        count(*) filter (where k in ('cl', 'cs')) confirmed_candidates, count(*) filter (where tier = 'EARLY_DISCOVERY') early_discoveries, count(*) filter (where tier = 'STRONG_DISCOVERY') strong_discoveries, round(median(discovery), 6) median_discovery_score from se group by 1""",
    "market_contexts": "select cx.symbol, round(mid * 100, 4) day_notional, cast(20 as double) spread, round(mid * 100 / base, 6) relative from cx join tb using (symbol)",
    "live_universe": "select name, round(notional, 2) notional, row_number() over (order by notional desc, name) place from (select * from mk where not delisted order by case when name in ('Brand#11', 'Brand#22') then 0 else 1 end, notional desc, name limit 6) x",
    "session_opens": "select symbol, round(o, 6) session_open from ev_d where t <= (select max(t) from ev_6) + 3600 and t + 86400 > (select max(t) from ev_6) + 3600",
    "admission": "select symbol, count(*) filter (where t + 86400 <= (select min(t) from ev_d) + 172800) completed, count(*) filter (where t + 86400 <= (select min(t) from ev_d) + 172800) >= 2 admitted from dg group by 1",
    "volume_blocks": "select symbol, t, round(day_notional, 4) day_notional, round(case when base > 0 then day_notional / base end, 6) relative from vb",
    "model_outcomes": "select symbol, t, cast(horizon as bigint) horizon, round(gross, 6) gross, round(case when beta_2 is null then adj else adj - beta_2 * (ms - g_beta * mb) end, 6) model_adjusted from mo2",
    "broad_forward": "select symbol, t, cast(horizon as bigint) horizon, case when steps = horizon then round(broad, 6) end broad from bf",
    "spec_evaluations": "select spec_id, t, count(*) evaluated, count(*) filter (where eligible) usable, count(*) filter (where state is not null) active, 4 - count(*) filter (where eligible) unavailable from sp group by 1, 2",
    "trigger_features": """select spec_id, sp.symbol, sp.t, round(score, 6) rs_score, round(discovery, 6) discovery_score, round(sum_medium, 6) residual_momentum_24h, round(mom, 6) residual_momentum_percentile, round(br, 6) positive_rs_breadth,
        cast(case when side = sp.direction then 1 else 0 end as double) completed_structure, cast(case rule when 'confirmed_candidate' then 3.5 when 'residual_momentum_baseline' then 0.8 else 3 end as double) trigger_threshold
        from sp join (select *, avg(case when score > 0 then 1.0 else 0 end) over (partition by t) br from se) z using (symbol, t) where sp.state is not null""",
    "persistence_study": """select symbol, t, round(p4, 6) p4, round(p8, 6) p8, round(m, 6) momentum, round(a - beta * b, 6) fwd4 from (select symbol, t, any_value(beta) beta, sum(sign(r)) filter (where j < 4) / 4.0 p4, sum(sign(r)) filter (where j < 8) / 8.0 p8, sum(r) filter (where j < 4) m from re group by 1, 2) x
        left join (select symbol, t, case when lead(t, 4) over w - t = 86400 then ln(lead(c, 4) over w / c) end a from ev_6 window w as (partition by symbol order by t)) y using (symbol, t)
        left join (select t, case when lead(t, 4) over w - t = 86400 then ln(lead(c, 4) over w / c) end b from ev_6 where symbol = 'click' window w as (order by t)) z using (t)""",
    "fold_counts": """select cast(horizon as bigint) horizon, f.i fold, case when t >= lo then 'test' else 'train' end part, count(*) n from (select *, s + (hs - s) * (0.65 + 0.35 * i / 3) lo, s + (hs - s) * (0.65 + 0.35 * (i + 1) / 3) hi from oc cross join (select a s, b - (b - a) * 0.2 hs from (select min(t) a, max(t) + 21600 b from ev_6) p) q cross join (values (0), (1), (2)) f(i)) f
        where t < hi and exit_t < hi and (t >= lo or exit_t < lo) group by 1, 2, 3""",
}


def chain(sql: str) -> str:
    """The query with just the steps that it needs, in order."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in STEPS.keys() & set(re.findall(r"(?:from|join) \(?(\w+)", text)) - needed:
            needed.add(name)
            add(STEPS[name])

    add(sql)
    steps = ",\n".join(f"{n} as ({STEPS[n]})" for n in STEPS if n in needed)
    whole = f"with {steps}\n{sql}" if steps else sql
    return re.sub(r"(?<![\w'\"])pivot(?![\w'\"])", '"pivot"', whole)  # a keyword of the dialect


def oracle_sql() -> dict[str, str]:
    return {name: chain(sql) for name, sql in QUERIES.items()}

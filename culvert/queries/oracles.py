"""SQL counterparts of the plan-set queries, composed of shared table expressions (DuckDB dialect)."""

from __future__ import annotations

from culvert import config as C
from culvert.operators import intake, references

Q = "''"


def _num(text: str) -> str:
    return f"try_cast(nullif(trim({text}),'') as double)"


def station(x: str) -> str:
    p = r"(?i)(?:STA[:.]?\s*)?(\d{1,4})\s*\+\s*(\d{1,2}(?:\.\d+)?)"
    return f"({_num(f"regexp_extract({x},'{p}',1)")}*100.0 + {_num(f"regexp_extract({x},'{p}',2)")})"


_OFFSET = rf"(-?\d+(?:\.\d+)?)\s*(?:{Q}|FT|FEET)?\s*([LR])T?"


def offset_distance(x: str) -> str:
    return _num(f"regexp_extract(upper(translate({x},',',' ')),'{_OFFSET}',1)")


def offset_side(x: str) -> str:
    s = f"regexp_extract(upper(translate({x},',',' ')),'{_OFFSET}',2)"
    return f"case {s} when 'R' then 'RT' when 'L' then 'LT' end"


def offset_or_center(x: str) -> str:
    return f"coalesce(nullif({x},''),'0{Q} CL')"


def effective_offset(x: str) -> str:
    t = offset_or_center(x)
    signed = f"(case when ({offset_side(t)})='LT' then -{offset_distance(t)} else {offset_distance(t)} end + 0.0)"
    return f"coalesce({signed}, case when contains(upper({t}),'CL') then 0.0 end)"


def token(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x},'')),'[^A-Z0-9]+','','g')"


def size_norm(x: str) -> str:
    return f"replace(upper(coalesce({x},'')),' ','')"


def diameter(x: str) -> str:
    return f"({_num(rf"regexp_extract({x},'(\d+(?:\.\d+)?)',1)")}/12.0)"


def plain(x: str) -> str:
    for a, b in (("∅", "DIA"), ("Ø", "DIA"), ("⌀", "DIA"), ("°", "deg"), ("′", "''"), ("″", '"'), ("±", "+/-")):
        x = f"replace({x},'{a}','{b}')"
    return x


def ids(x: str) -> str:
    return f"coalesce(list_filter({x}, lambda z: z is not null), [])"


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


_MEMBER = " or ".join(f"(utility='{u}' and kind in ({','.join(repr(t) for t in ts)}))" for u, ts in C.UTILITY_TYPES.items())
_PLACE = "plan_id, utility, page_number, kind"

TILES = "tl as (select * from (select *, row_number() over (partition by plan_id, tile_id order by ingested_at desc nulls last, extracted_at desc nulls last) rn_ from tiles where plan_id is not null and tile_id is not null) where rn_ = 1)"

OBS = f"""obs0 as (select s.* exclude (inverts, source_text_ids), coalesce(list_filter(s.inverts, lambda z: z is not null), []) inverts, {ids('s.source_text_ids')} source_text_ids,
  {token('structure_type')} kind, u.utility from structures s cross join (values ('SD'),('SS'),('W')) u(utility) where plan_id is not null and page_number is not null),
obs as (select o.*, {station('o.station')} station_ft, {offset_or_center('o.offset_txt')} offset_text, {effective_offset('o.offset_txt')} offset_ft,
  len(o.inverts) n_inverts, length(trim(coalesce(o.notes,''))) n_notes, len(o.source_text_ids) n_ids, coalesce(tl.sanitized, false) sanitized
  from obs0 o left join tl on tl.plan_id=o.plan_id and tl.tile_id=o.tile_id
  where kind <> '' and (contains(kind, utility) or {_MEMBER} or (kind='GB' and len(o.inverts) > 0)))"""

EXACT = f"""keyed as (select *, case when station_ft is not null and offset_ft is not null then 'at ' || cast(round(station_ft,2) as varchar) || ' ' || cast(round(offset_ft,2) as varchar)
   else 'text ' || {token('station')} || ' ' || {token('offset_text')} end as k from obs),
ranked as (select *, row_number() over (partition by {_PLACE}, k order by n_inverts desc, n_notes desc, n_ids desc, tile_id, obs_id) rk,
   row_number() over (partition by {_PLACE}, k order by n_notes desc, tile_id, obs_id) rkn, row_number() over (partition by {_PLACE}, k order by tile_id, obs_id) rks from keyed),
exact as (select {_PLACE}, k, arg_min({{'v':structure_type}}, rk).v structure_type, arg_min({{'v':station}}, rk).v station, arg_min({{'v':offset_text}}, rk).v "offset",
   arg_min({{'v':station_ft}}, rk).v station_ft, arg_min({{'v':offset_ft}}, rk).v offset_ft, arg_min(inverts, rk) inverts,
   arg_min(id, rk) filter (id is not null) id, arg_min(size, rk) filter (size is not null) size, arg_min(rim_elevation, rk) filter (rim_elevation is not null) rim_elevation,
   bool_or(coalesce(is_existing,false)) is_existing, arg_min({{'v':notes}}, rkn).v notes, list_distinct(list(tile_id)) tile_list,
   list_distinct(flatten(list(list_concat(source_text_ids, flatten(list_transform(inverts, lambda i: {ids('i.source_text_ids')})))))) text_list,
   bool_or(sanitized) sanitized, count(*) variants_count, coalesce(list_distinct(list(round(rim_elevation,4)) filter (rim_elevation is not null)), []) rim_values,
   arg_min(tile_id, rks) first_tile, arg_min(obs_id, rks) first_obs
   from ranked group by {_PLACE}, k)"""

_SAME = "n.plan_id=r.plan_id and n.utility=r.utility and n.page_number=r.page_number and n.kind=r.kind"
_HIT = f"list_filter(r.leads, lambda l: abs(l.st - n.station_ft) <= {C.MERGE_STATION_FT} and (l.off is null or n.offset_ft is null or abs(l.off - n.offset_ft) <= {C.MERGE_OFFSET_FT}))[1].s"
_NEW = "struct_pack(s:=n.seat, st:=n.station_ft, off:=n.offset_ft)"

LEADERS = f"""seated as (select *, row_number() over (partition by {_PLACE} order by station_ft nulls last, first_tile, first_obs) seat from exact),
led as (
  select n.plan_id, n.utility, n.page_number, n.kind, n.seat, n.seat as leader, case when n.station_ft is null then [] else [{_NEW}] end as leads from seated n where seat=1
  union all
  select n.plan_id, n.utility, n.page_number, n.kind, n.seat, coalesce({_HIT}, n.seat), case when n.station_ft is not null and {_HIT} is null then list_append(r.leads, {_NEW}) else r.leads end
  from led r join seated n on {_SAME} and n.seat = r.seat + 1),
members as (select s.*, led.leader from seated s join led using (plan_id, utility, page_number, kind, seat)),
mranked as (select *, row_number() over (partition by {_PLACE}, leader order by len(inverts) desc, length(trim(coalesce(notes,''))) desc, len(text_list) desc, seat) rk,
  row_number() over (partition by {_PLACE}, leader order by length(trim(coalesce(notes,''))) desc, seat) rkn from members),
nodes0 as (select {_PLACE}, leader, arg_min({{'v':structure_type}}, rk).v structure_type, arg_min({{'v':station}}, rk).v station, arg_min({{'v':"offset"}}, rk).v "offset",
  arg_min({{'v':station_ft}}, rk).v station_ft, arg_min({{'v':offset_ft}}, rk).v offset_ft, arg_min(inverts, rk) inverts,
  coalesce(nullif(arg_min({{'v':id}}, rk).v,''), arg_min(id, rk) filter (id is not null)) id, coalesce(nullif(arg_min({{'v':size}}, rk).v,''), arg_min(size, rk) filter (size is not null)) size,
  arg_min(rim_elevation, rk) filter (rim_elevation is not null) rim_elevation, bool_or(is_existing) is_existing, arg_min({{'v':notes}}, rkn).v notes,
  list_sort(list_distinct(flatten(list(tile_list)))) tile_list, list_sort(list_distinct(flatten(list(text_list)))) text_list, bool_or(sanitized) sanitized, cast(sum(variants_count) as bigint) variants_count,
  list_sort(list_distinct(flatten(list(rim_values)))) rim_values from mranked group by {_PLACE}, leader),
nodes1 as (select *, case when station_ft is not null and offset_ft is not null then printf('%s:%d:%s:%.2f:%+.2f', utility, page_number, coalesce(nullif({token('structure_type')},''),'STRUCT'), station_ft, offset_ft)
  else utility || ':' || page_number || ':' || coalesce(nullif({token('structure_type')},''),'STRUCT') || ':' || substr(sha1(concat_ws('|', utility, cast(page_number as varchar), coalesce(structure_type,'None'), coalesce(station,'None'), coalesce("offset",'None'))),1,10) end as node_id,
  list_min(list_transform(inverts, lambda i: i.elevation)) representative from nodes0),
nodes as (select n.*, coalesce(c.m, 1.0) min_coherence from nodes1 n left join (select n.plan_id, n.utility, n.node_id, min(tl.coherence_score) m from (select plan_id, utility, node_id, unnest(tile_list) tile_id from nodes1) n join tl using (plan_id, tile_id) group by 1,2,3) c using (plan_id, utility, node_id))"""

REFPAGES = "refpages as (select plan_id, page_number from tl where coalesce(lower(trim(sheet_type)),'') <> '' group by 1,2 having bool_or(lower(trim(sheet_type))='signing_striping') and not bool_or(lower(trim(sheet_type))='profile_view'))"

_BLOB = "concat_ws(' | ', upper(coalesce(id,'')), upper(coalesce(structure_type,'')), upper(coalesce(notes,'')))"


def _score(hint: str) -> str:
    h = rf"trim(regexp_replace(upper(coalesce({hint},'')),'\s+',' ','g'))"
    return f"case when {h}='' then 0 when contains(c.blob,{h}) then 2 when len(list_filter(string_split_regex({h},'[^A-Z0-9]+'), lambda w: w <> '' and contains(c.blob,w))) > 0 then 1 else 0 end"


def _confidence(d: str, s: str) -> str:
    return f"case when {d} is null then case when {s}>=1 then 'medium' else 'none' end when {s}>=2 and {d}<={C.HINT_CLOSE_FT} then 'high' when {s}>=1 and {d}<={C.HINT_MEDIUM_FT} then 'medium' when {d}<={C.HINT_CLOSE_FT} then 'medium' when {d}<={C.HINT_FAR_FT} then 'low' else 'none' end"


def _match(name: str, source: str, side: str, exclude: str) -> str:
    return f"""{name}_c as (select p.plan_id, p.utility, p.pipe_id, c.node_id, {_score(f'p.{side}_structure_hint')} score, abs(c.station_ft - p.{side}_ft) distance
  from {source} p join cand c on c.plan_id=p.plan_id and c.utility=p.utility and c.for_page=p.page_number
  where (nullif(p.{side}_structure_hint,'') is not null or p.{side}_ft is not null) {exclude}),
{name}_b as (select * from (select *, row_number() over (partition by plan_id, utility, pipe_id order by score desc, distance nulls last, node_id) rn from {name}_c) where rn=1),
{name} as (select p.*, b.node_id {side}_node0, case when b.node_id is not null then {_confidence('b.distance','b.score')} end {side}_conf0 from {source} p left join {name}_b b using (plan_id, utility, pipe_id))"""


def _infer(name: str, source: str, missing: str, anchor: str) -> str:
    return f"""{name}_c as (select p.plan_id, p.utility, p.pipe_id, c.node_id, c.page_number, c.station_ft, c.offset_ft, least(abs(c.station_ft - a.station_ft - p.length_lf), abs(c.station_ft - a.station_ft + p.length_lf)) delta
  from {source} p join nodes a on a.plan_id=p.plan_id and a.utility=p.utility and a.node_id=p.{anchor}_node0 join cand c on c.plan_id=p.plan_id and c.utility=p.utility and c.for_page=p.page_number
  where p.{missing}_node0 is null and p.length_lf > 0 and a.station_ft is not null and c.station_ft is not null and c.node_id <> p.{anchor}_node0),
{name}_b as (select * from (select *, row_number() over (partition by plan_id, utility, pipe_id order by delta, page_number, station_ft nulls last, offset_ft nulls last, node_id) rn from {name}_c) where rn=1 and delta <= {C.INFER_LOW_FT}),
{name} as (select p.* replace (coalesce(p.{missing}_node0, b.node_id) as {missing}_node0, coalesce(p.{missing}_conf0, case when b.node_id is not null then 'low' end) as {missing}_conf0) from {source} p left join {name}_b b using (plan_id, utility, pipe_id))"""


_WORSE = "['none','low','medium','high'][least(list_position(['none','low','medium','high'], {a}), list_position(['none','low','medium','high'], {b}))]"

MATCHED = f"""pp as (select p.* exclude (source_text_ids), list_sort(list_distinct({ids('p.source_text_ids')})) text_list, upper(trim(pipe_type)) utility,
  row_number() over (partition by p.plan_id, upper(trim(pipe_type)) order by p.tile_id, p.pipe_id) - 1 edge_no from pipes p where upper(trim(pipe_type)) in ('SD','SS','W') and p.plan_id is not null and p.page_number is not null and p.tile_id is not null),
pipes1 as (select pp.*, utility || ':e' || edge_no || ':' || pp.tile_id edge_id, coalesce(tl.sanitized,false) sanitized, coalesce(tl.coherence_score,1.0) source_coherence,
  coalesce(lower(trim(tl.sheet_type))='signing_striping', false) or r.plan_id is not null is_reference_only,
  coalesce({station('from_station')}, {station('from_structure_hint')}) from_ft, coalesce({station('to_station')}, {station('to_structure_hint')}) to_ft
  from pp left join tl using (plan_id, tile_id) left join refpages r on r.plan_id=pp.plan_id and r.page_number=pp.page_number),
npages as (select distinct plan_id, utility, page_number from nodes),
cand as (select n.*, {_BLOB} blob, n.page_number for_page from nodes n
  union all select n.*, {_BLOB} blob, q.page_number from (select distinct plan_id, utility, page_number from pipes1 anti join npages using (plan_id, utility, page_number)) q join nodes n on n.plan_id=q.plan_id and n.utility=q.utility),
{_match('m1', 'pipes1', 'from', '')},
{_match('m2', 'm1', 'to', 'and (p.from_node0 is null or c.node_id <> p.from_node0)')},
{_infer('m3', 'm2', 'to', 'from')},
{_infer('m4', 'm3', 'from', 'to')},
matched as (select *, from_node0 is null from_orphan, to_node0 is null to_orphan, coalesce(from_node0, 'orphan:'||utility||':'||edge_id||':from') from_node, coalesce(to_node0, 'orphan:'||utility||':'||edge_id||':to') to_node,
  coalesce(from_conf0,'none') from_conf, coalesce(to_conf0,'none') to_conf, {_WORSE.format(a="coalesce(from_conf0,'none')", b="coalesce(to_conf0,'none')")} matched_conf from m4)"""

_E = "list_filter(list_transform(inverts, lambda i: i.elevation), lambda x: x is not null)"
_D = f"list_filter(list_transform(inverts, lambda i: {diameter('i.pipe_size')}), lambda x: x is not null)"
_PAIR = "plan_id, utility, from_node, to_node"


def _ord(c: str) -> str:
    return f"list_position(['none','low','medium','high'], {c})"


EDGES = f"""lim as (select *, case when utility in ('SD','SS') and len({_E})>=2 and len({_D})>=1 and list_max({_E})-list_min({_E}) > list_max({_D})+{C.CROWN_SPREAD_FT} then list_min({_E})+list_max({_D})+{C.CROWN_SPREAD_FT} end lim from nodes),
cn0 as (select * exclude (inverts, representative, lim), list_filter(inverts, lambda i: lim is not null and i.elevation is not null and i.elevation > lim) crowns, list_filter(inverts, lambda i: not (lim is not null and i.elevation is not null and i.elevation > lim)) inverts from lim),
cn as (select *, list_min(list_transform(inverts, lambda i: i.elevation)) representative from cn0),
e1 as (select * exclude (rn) from (select *, row_number() over (partition by {_PAIR} order by edge_no desc) rn from matched) where rn=1),
e2 as (select e.*, coalesce(e.utility in ('SD','SS') and e.length_lf>0 and abs(u.representative-v.representative) > abs(e.slope)*e.length_lf*{C.CROWN_DROP_RATIO} and abs(u.representative-v.representative) > {C.CROWN_MIN_DROP_FT}, false) crown,
  [e.tile_id] tile_list, [e.page_number] page_list,
  ({_ord('matched_conf')})*1000000000.0 + ({_ord('from_conf')}+{_ord('to_conf')})*100000000.0 + ((coalesce(from_station,'')<>'')::int + (coalesce(to_station,'')<>'')::int)*10000000.0 + length(coalesce(e.notes,''))*1000.0 + len(e.text_list) rnk,
  coalesce(u.page_number*1.0, 1e18) sp, coalesce(u.station_ft, 1e18) ss, coalesce(u.offset_ft, 1e18) so
  from e1 e left join cn u on u.plan_id=e.plan_id and u.utility=e.utility and u.node_id=e.from_node left join cn v on v.plan_id=e.plan_id and v.utility=e.utility and v.node_id=e.to_node),
j as (select a.*, b.edge_id b_id, b.rnk b_rnk, b.tile_list b_tiles, b.page_list b_pages, b.text_list b_texts, b.sanitized b_san, b.crown b_crown, b.is_reference_only b_ref, b.from_station b_fs, b.to_station b_ts, b.from_structure_hint b_fh, b.to_structure_hint b_th, b.notes b_notes,
  (b.sp, b.ss, b.so, b.from_node) b_start, (a.sp, a.ss, a.so, a.from_node) a_start,
  coalesce(b.edge_id is not null and a.from_node <> a.to_node and {size_norm('a.size')}={size_norm('b.size')} and not coalesce(abs(a.length_lf-b.length_lf)>{C.EDGE_LENGTH_TOL},false) and not coalesce(abs(a.slope-b.slope)>{C.EDGE_SLOPE_TOL},false), false) dup
  from e2 a left join e2 b on b.plan_id=a.plan_id and b.utility=a.utility and b.from_node=a.to_node and b.to_node=a.from_node),
e3 as (select plan_id, utility, from_node, to_node, edge_id, size, material, length_lf, slope, from_conf, to_conf, matched_conf, from_orphan, to_orphan, source_coherence,
  case when dup then list_sort(list_distinct(list_concat(tile_list,b_tiles))) else tile_list end tile_list, case when dup then list_sort(list_distinct(list_concat(page_list,b_pages))) else page_list end page_list, case when dup then list_sort(list_distinct(list_concat(text_list,b_texts))) else text_list end text_list,
  sanitized or (dup and b_san) sanitized, crown or (dup and b_crown) crown, is_reference_only or (dup and b_ref) is_reference_only,
  case when dup and coalesce(from_station,'')='' and coalesce(b_fs,'')<>'' then b_fs else from_station end from_station, case when dup and coalesce(to_station,'')='' and coalesce(b_ts,'')<>'' then b_ts else to_station end to_station,
  case when dup and coalesce(from_structure_hint,'')='' and coalesce(b_fh,'')<>'' then b_fh else from_structure_hint end from_structure_hint, case when dup and coalesce(to_structure_hint,'')='' and coalesce(b_th,'')<>'' then b_th else to_structure_hint end to_structure_hint
  from j where not dup or rnk > b_rnk or (rnk = b_rnk and a_start < b_start)),
e4 as (select e.*, coalesce(e.utility in ('SD','SS') and u.representative < v.representative - {C.INVERT_TOL}, false) turn from e3 e left join cn u on u.plan_id=e.plan_id and u.utility=e.utility and u.node_id=e.from_node left join cn v on v.plan_id=e.plan_id and v.utility=e.utility and v.node_id=e.to_node),
e5 as (select * replace (case when turn then to_node else from_node end as from_node, case when turn then from_node else to_node end as to_node, case when turn then to_station else from_station end as from_station, case when turn then from_station else to_station end as to_station,
  case when turn then to_structure_hint else from_structure_hint end as from_structure_hint, case when turn then from_structure_hint else to_structure_hint end as to_structure_hint, case when turn then to_conf else from_conf end as from_conf, case when turn then from_conf else to_conf end as to_conf,
  case when turn then to_orphan else from_orphan end as from_orphan, case when turn then from_orphan else to_orphan end as to_orphan), case when turn then from_node end original_from_node from e4),
e6 as (select *, row_number() over (partition by {_PAIR} order by turn::int desc) rn, bool_or(crown) over (partition by {_PAIR}) any_crown from e5),
edges as (select * exclude (rn, crown), any_crown crown from e6 where rn=1)"""

RECORDS = "recs as (select plan_id, tile_id from structures union select plan_id, tile_id from pipes)"
QUALITY = f"""quality as (select plan_id, count(*) total_tiles, count(*) filter (st='ok') ok_tiles, count(*) filter (st='ok' and sanitized) sanitized_tiles, count(*) filter (st='skipped_low_coherence') skipped_tiles
  from (select coalesce(t.plan_id, r.plan_id) plan_id, coalesce(t.status,'ok') st, coalesce(t.sanitized,false) sanitized from (select * from recs where plan_id is not null and tile_id is not null) r full join tl t using (plan_id, tile_id)) group by 1)"""


def _directional(me: str, other: str) -> str:
    d = f"({other}.station_ft - {me}.station_ft)"
    prefer = f"case when {d} > {C.STATION_DELTA_FT} then ['E','NE','SE'] when {d} < -{C.STATION_DELTA_FT} then ['W','NW','SW'] when abs({other}.offset_ft) > abs({me}.offset_ft) then ['N','NE','NW'] when abs({other}.offset_ft) < abs({me}.offset_ft) then ['S','SE','SW'] end"
    pointed = f"list_filter({me}.inverts, lambda i: list_contains({prefer}, upper(coalesce(i.direction,''))) and i.elevation is not null)"
    sized = f"list_filter({pointed}, lambda i: {size_norm('e.size')} <> '' and {size_norm('i.pipe_size')} = {size_norm('e.size')})"
    return f"case when ({prefer}) is not null then coalesce({sized}[1].elevation, {pointed}[1].elevation, {me}.representative) else {me}.representative end"


ENDS = f"""ends as (select e.*, {_directional('u', 'v')} upstream, {_directional('v', 'u')} downstream, u.text_list u_texts, v.text_list v_texts, u.page_number u_page, v.page_number v_page, u.sanitized u_san, v.sanitized v_san, u.min_coherence u_coh, v.min_coherence v_coh,
  coalesce(len(u.crowns),0) u_crowns, coalesce(len(v.crowns),0) v_crowns from edges e left join cn u on u.plan_id=e.plan_id and u.utility=e.utility and u.node_id=e.from_node left join cn v on v.plan_id=e.plan_id and v.utility=e.utility and v.node_id=e.to_node)"""


def _extraction(coherence: str, sanitized: str) -> str:
    return f"case when {coherence} >= {C.CONFIDENCE_HIGH} and not {sanitized} then 'high' when {coherence} >= {C.CONFIDENCE_MEDIUM} or {sanitized} then 'medium' else 'low' end"


_EDGE_CONF = _extraction("source_coherence", "sanitized")
_NODE_CONF = _extraction("least(1.0, coalesce(u_coh,1.0), coalesce(v_coh,1.0))", "(coalesce(u_san,false) or coalesce(v_san,false))")
_CALC = "(abs(upstream-downstream)/length_lf)"
_CROWN = f"((slope = 0 or {_CALC}/abs(slope) > {C.CROWN_SLOPE_RATIO}) and (crown or u_crowns>0 or v_crowns>0))"

SLOPE = f"""slope_f as (select plan_id, utility, case when {_CROWN} then 'crown_contamination' else 'slope_mismatch' end finding_type, case when {_CROWN} then 'info' else 'warning' end severity,
  {joined('list_filter(list_concat(page_list,[u_page,v_page]), lambda z: z is not null)')} source_sheets, {joined('list_concat(list_concat(text_list, coalesce(u_texts,[])), coalesce(v_texts,[]))')} source_text_ids,
  from_node||','||to_node node_ids, edge_id edge_ids, {_WORSE.format(a=f'({_EDGE_CONF})', b=f'({_NODE_CONF})')} extraction_confidence, case when {_CROWN} then 'medium' else 'high' end check_confidence
  from ends where length_lf > 0 and slope is not null and upstream is not null and downstream is not null and abs({_CALC}-slope) > {C.SLOPE_TOL})"""

FLOW = f"flow_f as (select * from ends where utility in ('SD','SS') and not from_orphan and not to_orphan and downstream > upstream + {C.INVERT_TOL})"

ELEVATION = f"""elev_f as (select plan_id, utility, 'elevation_mismatch' finding_type, 'warning' severity, cast(page_number as varchar) source_sheets, array_to_string(text_list,',') source_text_ids, node_id node_ids, '' edge_ids,
  printf('%.2f-%.2f', list_min(rim_values), list_max(rim_values)) expected_value, {_extraction('min_coherence','sanitized')} extraction_confidence, 'high' check_confidence from cn where len(rim_values) > 1 and list_max(rim_values)-list_min(rim_values) > {C.RIM_TOL})"""

_BLANK = "coalesce(from_station,'')='' and coalesce(to_station,'')='' and coalesce(from_structure_hint,'')='' and coalesce(to_structure_hint,'')=''"
CONNECT = f"""wn as (select distinct plan_id, utility from cn),
touched as (select plan_id, utility, from_node node_id from edges union select plan_id, utility, to_node from edges),
alone as (select n.*, coalesce((q.sanitized_tiles+q.skipped_tiles)/q.total_tiles > {C.BAD_RATIO}, false) poor from (select * from cn anti join touched using (plan_id, utility, node_id)) n left join quality q using (plan_id)),
conn_f as (select plan_id, utility, 'connectivity_unverifiable' finding_type, 'info' severity, '' source_sheets, '' source_text_ids, '' node_ids, '' edge_ids, 'high' extraction_confidence, 'medium' check_confidence from (select distinct plan_id, utility from edges anti join wn using (plan_id, utility))
  union all select plan_id, utility, 'orphan_node', 'warning', cast(page_number as varchar), array_to_string(text_list,','), node_id, '', {_extraction('min_coherence','sanitized')}, 'medium' from alone where not poor
  union all select plan_id, utility, 'orphan_node_check_suppressed', 'info', '', '', '', '', 'high', 'medium' from alone where poor group by 1,2
  union all select plan_id, utility, case when {_BLANK} then 'unanchored_pipe' else 'dead_end_pipe' end, case when {_BLANK} then 'info' else 'warning' end, {joined('page_list')}, array_to_string(text_list,','), from_node||','||to_node, edge_id, {_EDGE_CONF}, 'low'
   from edges semi join wn using (plan_id, utility) where not is_reference_only and (matched_conf='none' or from_orphan or to_orphan))"""

_F = "plan_id, utility, finding_type, severity, source_sheets, source_text_ids, node_ids, edge_ids, extraction_confidence, check_confidence"
ALL = f"""flow_r as (select plan_id, utility, 'flow_direction_error' finding_type, 'error' severity, {joined('page_list')} source_sheets, {joined('list_concat(list_concat(text_list, coalesce(u_texts,[])), coalesce(v_texts,[]))')} source_text_ids, from_node||','||to_node node_ids, edge_id edge_ids, {_NODE_CONF} extraction_confidence, 'high' check_confidence from flow_f),
allf as (select 0 check_no, {_F} from conn_f union all select 1, {_F} from flow_r union all select 2, {_F} from slope_f union all select 3, {_F} from elev_f)"""

NODES = [TILES, OBS, EXACT, LEADERS]
GRAPH = [*NODES, REFPAGES, MATCHED]
FULL = [*GRAPH, EDGES]
CHECKS = [*FULL, RECORDS, QUALITY, ENDS, SLOPE, FLOW, ELEVATION, CONNECT, ALL]


def sql(parts: list[str], final: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + final if parts else final


_STATUS = "case when lower(trim(coalesce(status,''))) in (" + ",".join(f"'{s}'" for s in C.STATUSES) + ") then lower(trim(coalesce(status,''))) else 'runtime_error' end"
_ITEM = f"trim({plain("coalesce(i.text,'')")})"
LAYERS = f"""spans as (select layer_id, plan_id, tile_id, page_number, list_filter(list_transform(coalesce(list_filter(text_items, lambda i: i is not null),[]), lambda i: struct_pack(t:={_ITEM}, f:=trim(coalesce(i.font,'')))), lambda s: s.t <> '') s from text_layers),
fonts as (select layer_id, f, count(*) n, min(pos) first from (select layer_id, unnest(s).f f, generate_subscripts(s,1) pos from spans) where f <> '' group by 1,2),
layer as (select *, case when total_spans>0 then multi_char_spans/total_spans else 0.0 end coherence from (select layer_id, plan_id, page_number, len(s) total_spans, len(list_filter(s, lambda x: length(x.t)>1)) multi_char_spans, len(list_filter(s, lambda x: length(x.t)>1 and regexp_matches(x.t,'[0-9]'))) numeric_spans,
  coalesce((select f from fonts where fonts.layer_id=spans.layer_id order by n desc, first limit 1),'') primary_font from spans))"""
_GRID = intake.tile_clips()
SPANS = f"""sp as (select layer_id, plan_id, page_number, pos, trim({plain("coalesce(i.text,'')")}) txt, i.bbox_global[1] x0, i.bbox_global[2] y0, i.bbox_global[3] x1, i.bbox_global[4] y1 from (select layer_id, plan_id, page_number, unnest(list_filter(text_items, lambda z: z is not null)) i, generate_subscripts(list_filter(text_items, lambda z: z is not null),1)-1 pos from text_layers)),
sp1 as (select * from sp where txt <> '' and x0 is not null and y1 is not null)"""
CLIPS = "clips(r,c,x0,y0,x1,y1) as (values " + ",".join(str(tuple(float(v) if i > 1 else v for i, v in enumerate(c))) for c in _GRID) + ")"


def _shown(c: str) -> str:
    return f"coalesce(nullif(cast({c} as varchar),''),'-')"


def _fixed(c: str, n: int) -> str:
    return f"case when {c} is null then '-' else printf('%.{n}f', {c}) end"


def _contains_any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text},'{w}')" for w in words) + ")"


_SHEET_SCORES = ",".join("(" + "+".join(f"contains(t,'{w}')::int" for w in ws) + ")" for ws in intake.SHEET_WORDS.values())
_SHEET_NAMES = ",".join(f"'{k}'" for k in intake.SHEET_WORDS)
_SHEET_TYPE = f"case when list_max([{_SHEET_SCORES}])=0 then 'other' else ([{_SHEET_NAMES}])[list_position([{_SHEET_SCORES}], list_max([{_SHEET_SCORES}]))] end"
_LABEL = r"(?:^|[^A-Z0-9_])([A-Z]{1,4})\s*-?\s*([0-9]{1,3}[A-Z]?)(?:$|[^A-Z0-9_])"
_LABEL_OF = f"case when regexp_extract(l,'{_LABEL}',2)<>'' then regexp_extract(l,'{_LABEL}',1)||'-'||regexp_extract(l,'{_LABEL}',2) end"
_LIST_LABEL = f"list_filter(list_transform(string_split(raw, chr(10)), lambda y: case when regexp_extract(regexp_replace(upper(y),'[^A-Z0-9-]','','g'),'{_LABEL}',2)<>'' then regexp_extract(regexp_replace(upper(y),'[^A-Z0-9-]','','g'),'{_LABEL}',1)||'-'||regexp_extract(regexp_replace(upper(y),'[^A-Z0-9-]','','g'),'{_LABEL}',2) end), lambda z: z is not null)[1]"
_TIER = "case when coherence < 0.5 then 'premium' when sheet_type in ('cover','notes','demolition','erosion','other','signing_striping') then 'fast' when sheet_type in ('detail') then 'premium' else 'standard' end"
_AT = r"(?:^|[^A-Z0-9_])([A-Z]{1,4}\s*-?\s*[0-9]{1,3}[A-Z]?)(?:$|[^A-Z0-9_])"
_DROPPED = "array_to_string(list_filter([" + ",".join(f"case when dropped_invalid_counts.{k}>0 then '{k}='||dropped_invalid_counts.{k} end" for k in ("structures", "pipes", "inverts", "callouts")) + "], lambda z: z is not null), ', ')"
_ARTIFACTS = f"""arts as (select t.plan_id, t.tile_id, t.deliveries, {_STATUS.replace('status', 't.status')} status, coalesce(t.sanitized,false) sanitized, t.page_number, l.plan_id is not null has_layer, r.plan_id is not null has_records
  from (select plan_id, tile_id, count(*) deliveries, arg_max(status, ingested_at) status, arg_max(sanitized, ingested_at) sanitized, arg_max(page_number, ingested_at) page_number from tiles group by 1,2) t
  left join (select distinct plan_id, tile_id from text_layers) l using (plan_id, tile_id) left join recs r using (plan_id, tile_id)),
msgs as (select *, (deliveries>1)::int + (not has_layer and status<>'missing_text_layer')::int + (status='ok' and not has_records)::int + coalesce((try_cast(nullif(regexp_extract(tile_id,'(?i)^p(\\d+)_(?:r\\d+_c\\d+|a\\d+)$',1),'') as int) <> page_number)::int,0) critical,
  (status='missing_text_layer' and has_layer)::int + (status in ('dry_run','skipped_low_coherence','missing_text_layer') and has_records)::int warnings from arts)"""
_CATEGORY = "case " + " ".join(f"when {_contains_any("upper(coalesce(description,''))", ws)} then '{k}'" for k, ws in references.CATEGORY_WORDS.items()) + " else 'other' end"
_MENTION = r"(?i)SHEETS?\s+([A-Z]{0,3}[0-9]{1,3}(?:\s*[-,&/]\s*[A-Z]{0,3}[0-9]{1,3})*)"
_CAND = r"(?i)```(?:json)?\s*(\{[\s\S]*\})\s*```"
_T = r"regexp_replace(payload,'^\s+|\s+$','','g')"

ORACLES = {
    "parse_station_offset": f"select obs_id, {station('station')} station_ft, {offset_distance('offset_txt')} distance, {offset_side('offset_txt')} side, {effective_offset('offset_txt')} offset_ft from structures",
    "normalize_tokens": f"select obs_id, {token('structure_type')} token, regexp_replace(translate(lower(trim(coalesce(structure_type,''))),'- ','__'),'[^a-z0-9_]+','','g') label, {size_norm('size')} size_norm, round({diameter('size')},6) diameter_ft, {plain('offset_txt')} plain_offset from structures",
    "page_arguments": "select plan_id, page_number, page_number||','||(page_number+1)||','||(page_number+2)||','||(page_number+5) pages from sheets where page_number is not null",
    "cache_keys": "select layer_id, substr(sha256(cast(json_object('page_number', page_number, 'plan_id', plan_id, 'tile_id', tile_id) as varchar)),1,16) cache_key from text_layers",
    "utility_filter": sql([TILES, OBS], "select obs_id, utility, kind, sanitized from obs"),
    "exact_merge": sql([TILES, OBS, EXACT], f'select plan_id, utility, page_number, kind, structure_type, station, "offset", id, size, rim_elevation, notes, is_existing, sanitized, variants_count, len(inverts) n_inverts, {joined("tile_list")} tiles, {joined("text_list")} texts, len(rim_values) n_rims from exact'),
    "merged_nodes": sql(NODES, f'select plan_id, utility, page_number, node_id, structure_type, station, "offset", id, size, rim_elevation, notes, is_existing, sanitized, variants_count, {joined("tile_list")} tiles, {joined("text_list")} texts, representative, min_coherence from nodes'),
    "reference_pages": sql([TILES, REFPAGES], "select * from refpages"),
    "endpoint_match": sql(GRAPH, "select plan_id, utility, pipe_id, edge_id, from_node, to_node, from_conf, to_conf, matched_conf, from_orphan, to_orphan, is_reference_only from matched"),
    "crown_filter": sql(FULL, "select plan_id, utility, node_id, len(crowns) crowns, len(inverts) kept, representative from cn where len(crowns)>0"),
    "network_edges": sql(FULL, f"select plan_id, utility, from_node, to_node, edge_id, from_station, to_station, from_structure_hint, to_structure_hint, matched_conf, from_conf, to_conf, sanitized, crown crown_candidate, turn oriented_by_gravity, original_from_node, {joined('tile_list')} tiles, {joined('text_list')} texts from edges"),
    "quality_summary": sql([TILES, RECORDS, QUALITY], f"""select *, round(r,6) bad_ratio, case when r<={C.GRADE_A} then 'A' when r<={C.GRADE_B} then 'B' when r<={C.GRADE_C} then 'C' else 'D' end quality_grade,
      array_to_string(list_filter([case when sanitized_tiles>0 then sanitized_tiles||' tiles had sanitizer recovery' end, case when skipped_tiles>0 then skipped_tiles||' tiles skipped (low coherence)' end, case when r>{C.BAD_RATIO} then 'Extraction quality below threshold — findings may be incomplete' end], lambda z: z is not null), '; ') warnings from (select *, (sanitized_tiles+skipped_tiles)/total_tiles r from quality)""").replace("select *, round(r,6)", "select * exclude (r), round(r,6)"),
    "status_counts": sql([TILES], "select plan_id, " + ", ".join(f"count(*) filter ({_STATUS}='{s}') {s}" for s in C.STATUSES) + " from tl group by 1"),
    "connectivity": sql(CHECKS, f"select {_F} from conn_f"),
    "flow_direction": sql(CHECKS, "select * from flow_r"),
    "directional_inverts": sql([*FULL, ENDS], "select plan_id, utility, edge_id, upstream, downstream from ends"),
    "slope_consistency": sql(CHECKS, "select * from slope_f"),
    "elevation_mismatch": sql(CHECKS, "select plan_id, utility, finding_type, severity, source_text_ids, node_ids, expected_value, extraction_confidence from elev_f"),
    "pipe_size_conflict": f"""select plan_id, pipe_type, count(*) segments, cast(sum(n) as bigint) sizes from (select plan_id, upper(pipe_type) pipe_type, case when a is not null and b is not null then 's'||round(least(a,b),2)||'|'||round(greatest(a,b),2) else 'l'||round(coalesce(length_lf,0.0),1)||'|'||round(coalesce(slope,0.0),4) end seg, count(distinct nullif(size,'')) n
      from (select *, {station('from_station')} a, {station('to_station')} b from pipes where pipe_type is not null) group by 1,2,3) where n > 1 group by 1,2""",
    "run_checks": sql(CHECKS, "select plan_id, utility, check_no, finding_type, severity, node_ids, edge_ids, extraction_confidence, check_confidence from allf"),
    "findings_report": sql(CHECKS, "select plan_id, case severity when 'error' then 0 when 'warning' then 1 when 'info' then 2 else 99 end rank, utility, case when extraction_confidence='low' then finding_type||' [VERIFY]' else finding_type end finding, severity, replace(source_sheets,',',', ') pages from allf"),
    "severity_counts": sql(CHECKS, "select plan_id, severity, count(*) n from allf group by 1,2"),
    "structure_schedule": sql(FULL, f"""select plan_id, utility, node_id, station_ft, {_shown('station')} station, {_shown('"offset"')} "offset", {_shown('structure_type')} structure_type, {_shown('size')} size, {_fixed('rim_elevation', 2)} rim,
      {_shown("array_to_string(list_transform(inverts, lambda i: case when i.elevation is null then upper(coalesce(i.direction,'?')) else upper(coalesce(i.direction,'?'))||':'||printf('%.2f', i.elevation) end), ', ')")} inverts, {_shown('notes')} notes, printf('pg %d, %d tile(s)', page_number, len(tile_list)) provenance from cn"""),
    "pipe_schedule": sql(FULL, f"""select e.plan_id, e.utility, edge_id, case when from_orphan then 'ORPHAN' else coalesce(nullif(concat_ws(' ', nullif(upper(trim(u.structure_type)),''), nullif(trim(u.station),'')),''), from_node) end from_label, case when to_orphan then 'ORPHAN' else coalesce(nullif(concat_ws(' ', nullif(upper(trim(v.structure_type)),''), nullif(trim(v.station),'')),''), to_node) end to_label,
      {_shown('e.size')} size, {_fixed('length_lf', 2)} length, {_fixed('slope', 4)} slope, {_shown('material')} material, case when turn then matched_conf||'; gravity-oriented' else matched_conf end confidence
      from edges e left join cn u on u.plan_id=e.plan_id and u.utility=e.utility and u.node_id=e.from_node left join cn v on v.plan_id=e.plan_id and v.utility=e.utility and v.node_id=e.to_node where not (from_orphan and to_orphan)"""),
    "batch_results": f"select plan_id, tile_id, {_fixed('coherence_score', 3)} coherence, coalesce(structures_count,0) structures, coalesce(pipes_count,0) pipes, coalesce(callouts_count,0) callouts, case when coalesce(sanitized,false) then case when coalesce({_DROPPED},'')<>'' then 'yes ('||{_DROPPED}||')' else 'yes' end else 'no' end sanitized from tiles",
    "batch_totals": "select plan_id, model, count(distinct page_number) pages, count(*) tiles, round(sum(usage_cost),6) total_cost from tiles group by 1,2",
    "coherence": sql([LAYERS], f"select layer_id, total_spans, multi_char_spans, numeric_spans, primary_font, round(coherence,6) coherence, coherence >= {C.COHERENCE_VIABLE} is_viable from layer"),
    "page_coherence": sql([LAYERS], "select *, round(case when total_spans>0 then multi_char_spans/total_spans else 0.0 end,6) coherence from (select plan_id, page_number, cast(sum(total_spans) as bigint) total_spans, cast(sum(multi_char_spans) as bigint) multi_char_spans, cast(sum(numeric_spans) as bigint) numeric_spans from layer group by 1,2)"),
    "layer_routing": sql([LAYERS], f"select layer_id, case when coherence < {C.COHERENCE_VIABLE} then 'skipped_low_coherence' else 'extract' end decision, coherence < {C.COHERENCE_ESCALATE} needs_escalation, case when coherence < {C.COHERENCE_ESCALATE} then 'low_coherence' end escalation_reason from layer"),
    "sheet_classify": sql([LAYERS, f"texts as (select layer_id, array_to_string(list_transform(coalesce(list_filter(text_items, lambda i: i is not null),[]), lambda i: coalesce(i.text,'')), chr(10)) raw from text_layers)", f"cls as (select layer_id, raw, upper(raw) l, upper(raw) t, coherence from texts join layer using (layer_id))", f"cls2 as (select *, {_SHEET_TYPE} sheet_type from cls)"],
      f"""select layer_id, coalesce({_LIST_LABEL}, {_LABEL_OF}) as "label", sheet_type, array_to_string(list_filter([case when {_contains_any("' '||t||' '", [' SD ', 'STORM DRAIN'])} then 'SD' end, case when {_contains_any("' '||t||' '", [' SS ', 'SANITARY SEWER', 'SEWER'])} then 'SS' end, case when {_contains_any("' '||t||' '", [' W ', ' WATER ', 'POTABLE WATER'])} then 'W' end], lambda z: z is not null), ',') utilities, {_TIER} tier from cls2"""),
    "sheet_index": rf"""with lines as (select layer_id group_id, trim(i.text) line, pos from (select layer_id, unnest(text_items) i, generate_subscripts(text_items,1) pos from text_layers)),
      x as (select group_id, pos, line, regexp_extract(upper(line),'{_AT}',1) raw from lines), y as (select *, regexp_replace(regexp_replace(substr(line, instr(upper(line), raw) + length(raw)),'^[ \-:\t]+',''),'[ \-:\t]+$','') description from x where raw <> '')
      select group_id, regexp_replace(regexp_replace(raw,'[^A-Z0-9-]','','g'),'^([A-Z]+)-?','\1-') as "label", arg_max(description, pos) description from y where description <> '' group by 1,2""",
    "tile_clips": sql([CLIPS], "select plan_id, page_number, printf('p%d_r%d_c%d', page_number, r, c) tile_id, round(x0,3) x0, round(y0,3) y0, round(x1,3) x1, round(y1,3) y1 from (select distinct plan_id, page_number from sheets where plan_id is not null and page_number is not null) cross join clips"),
    "title_blocks": sql([SPANS], "select layer_id, count(*) spans from sp1 where x0 >= {} and y0 >= {} and x1 <= {} and y1 <= {} group by 1".format(*intake.title_block_rect())),
    "span_tiles": sql([SPANS, CLIPS], """select plan_id, page_number, r as "row", c as col, row_number() over (partition by plan_id, page_number, r, c order by seen_l, seen_p, txt, x0, y0, x1, y1) - 1 text_id, txt as "text", round(x0-cx,2) local_x, round(y0-cy,2) local_y
      from (select plan_id, page_number, r, c, cx, cy, txt, x0, y0, x1, y1, min((layer_id,pos))[1] seen_l, min((layer_id,pos))[2] seen_p from (select plan_id, page_number, r, c, clips.x0 cx, clips.y0 cy, layer_id, pos, txt, round(s.x0,2) x0, round(s.y0,2) y0, round(s.x1,2) x1, round(s.y1,2) y1 from sp1 s join clips on s.x0 < clips.x1+5 and s.x1 > clips.x0-5 and s.y0 < clips.y1+5 and s.y1 > clips.y0-5) group by all)"""),
    "occupancy": sql([SPANS], """select distinct plan_id, page_number, r, c from (select plan_id, page_number, unnest(generate_series(greatest(floor(y0/108.0),0)::int, least(floor((y1-1e-9)/108.0),15)::int)) r, c from (select *, unnest(generate_series(greatest(floor(x0/108.0),0)::int, least(floor((x1-1e-9)/108.0),23)::int)) c from (select plan_id, page_number, greatest(x0,0.0) x0, greatest(y0,0.0) y0, least(x1,2592.0) x1, least(y1,1728.0) y1 from sp1) where x0<x1 and y0<y1))"""),
    "pair_layers": "select distinct plan_id, tile_id, case when exists (select 1 from text_layers l where l.plan_id=t.plan_id and l.tile_id=t.tile_id) then 'paired' else 'missing_text_layer' end state from tiles t",
    "page_model_tiers": "select plan_id, page_number, coalesce(arg_max(model_tier, (coalesce(revision,-1), registered_at, coalesce(model_tier,''))),'standard') model_tier from sheets where plan_id is not null and page_number is not null group by 1,2",
    "json_candidate": rf"select raw_id, case when starts_with({_T},'{{') and ends_with({_T},'}}') then {_T} else coalesce(nullif(regexp_extract(payload,'{_CAND}',1),''), case when contains({_T},'{{') and contains({_T},'}}') and length({_T})-instr(reverse({_T}),'}}')+1 > instr({_T},'{{') then substr({_T}, instr({_T},'{{'), length({_T})-instr(reverse({_T}),'}}')+1-instr({_T},'{{')+1) end) end candidate from raw_extractions",
    "salvaged_objects": r"select raw_id, len(list_filter(regexp_extract_all(payload,'\{[^{}]+\}'), lambda o: json_valid(o))) objects from raw_extractions where payload is not null",
    "prompt_items": "select layer_id, len(list_filter(text_items, lambda i: i is not null and i.text_id is not null and coalesce(length(trim(i.text)),0)>0 and len(i.bbox_local)=4)) n_items from text_layers where text_items is not null",
    "package_artifacts": sql([RECORDS, _ARTIFACTS], "select plan_id, tile_id, status, deliveries, has_layer, has_records, critical, warnings from msgs"),
    "package_report": sql([RECORDS, _ARTIFACTS], f"""select plan_id, artifacts, paired_tiles, sanitized_tiles, skipped_tiles, critical_errors, warnings, round(r,6) bad_ratio, case when critical_errors>0 then 'fail' when warnings>0 then 'warn' else 'pass' end verdict from (select * replace (critical_errors + (r>{C.PACKAGE_FAIL})::int as critical_errors, warnings + (r>{C.PACKAGE_WARN} and r<={C.PACKAGE_FAIL})::int as warnings) from (select *, case when paired_tiles>0 then (sanitized_tiles+skipped_tiles)/paired_tiles else 0.0 end r from
      (select plan_id, count(*) artifacts, count(*) filter (status<>'missing_text_layer') paired_tiles, count(*) filter (sanitized) sanitized_tiles, count(*) filter (status='skipped_low_coherence') skipped_tiles, cast(sum(critical) as bigint) critical_errors, cast(sum(warnings) as bigint) warnings from msgs group by 1)))"""),
    "declared_counts": "select *, declared_structures=found_structures and declared_pipes=found_pipes and declared_callouts=found_callouts agrees from (select plan_id, tile_id, max(coalesce(structures_count,0)) declared_structures, max(coalesce(pipes_count,0)) declared_pipes, max(coalesce(callouts_count,0)) declared_callouts, "
    + ", ".join(f"coalesce(any_value({k[0]}{k[1]}.n),0) found_{k}" for k in ("structures", "pipes", "callouts"))
    + " from tiles t "
    + " ".join(f"left join (select plan_id, tile_id, count(*) n from {k} group by 1,2) {k[0]}{k[1]} using (plan_id, tile_id)" for k in ("structures", "pipes", "callouts"))
    + " where plan_id is not null and tile_id is not null group by 1,2)",
    "submitted_returned": "with a as (select distinct concat_ws('/',plan_id,tile_id) tile from tiles), b as (select distinct concat_ws('/',plan_id,tile_id) tile from raw_extractions where plan_id is not null and tile_id is not null) select tile, 'not_returned' state from a anti join b using (tile) union all select tile, 'unknown' from b anti join a using (tile)",
    "xref_issues": f"""with lines as (select plan_id, page_number, concat_ws(' ', callout_text, reference_sheet) line from callouts where plan_id is not null and page_number is not null), tp as (select plan_id, max(page_number) n from sheets group by 1),
      g as (select plan_id, page_number, unnest(regexp_extract_all(line,'{_MENTION}',1)) grp from lines where not regexp_matches(line,'{references.EXTERNAL}')), c0 as (select plan_id, page_number, unnest(regexp_extract_all(grp,'([A-Z]{{0,3}}[0-9]{{1,3}})',1)) code from g),
      c1 as (select distinct c0.plan_id, page_number, case when regexp_matches(code,'^[0-9]+$') then regexp_replace(code,'^0+([0-9])','\\1') else code end code, n from c0 left join tp using (plan_id)), c2 as (select * from c1 where not regexp_matches(code,'^[0-9]+$') or try_cast(code as int) <= n),
      idx as (select plan_id, regexp_replace(upper(sheet_label),'[^A-Z0-9]','','g') code from sheets where sheet_label is not null union select plan_id, cast(page_number as varchar) from sheets where page_number is not null)
      select plan_id, code, {joined('list(page_number)')} pages, bool_or(idx.code is not null) valid, cast(count(distinct page_number) as int) page_count, case when not bool_or(idx.code is not null) then case when count(distinct page_number)>=10 then 'High' when count(distinct page_number)>=3 then 'Medium' else 'Low' end end severity from c2 left join idx using (plan_id, code) group by 1,2""".replace("bool_or(idx.code is not null)", "bool_or(hit)").replace("from c2 left join idx using (plan_id, code)", "from (select c2.*, exists (select 1 from idx where idx.plan_id=c2.plan_id and idx.code=c2.code) hit from c2)"),
    "sheet_categories": f"select plan_id, page_number, revision, {_CATEGORY} category from sheets",
    "calibration_score": f"""with e as (select plan_id, merged_id, page_number, upper(structure_type) t, {station('station')} ft, rim_elevation rim from merged_structures), o as (select plan_id, page_number, tile_id, obs_id, upper(structure_type) t, {station('station')} ft, rim_elevation rim from structures),
      h as (select e.plan_id, e.merged_id, arg_min({{'o':o.obs_id,'r':o.rim}}, (o.tile_id,o.obs_id)) m from e join o on o.plan_id=e.plan_id and o.page_number=e.page_number and abs(o.ft-e.ft)<=0.05 and contains(o.t,e.t) group by 1,2)
      select e.plan_id, count(*) facts, count(*) filter (h.merged_id is not null and (e.rim is null or coalesce(abs(h.m.r-e.rim)<=0.05,false))) passed, count(h.merged_id) matched from e left join h using (plan_id, merged_id) group by 1""",
    "distinct_structures": "select plan_id, structure_type, station, offset_txt, min(obs_id) obs_id, arg_min({'v':size}, obs_id).v size, count(*) observations from structures group by 1,2,3,4",
    "distinct_pipes": "select plan_id, pipe_type, size, from_station, to_station, min(pipe_id) pipe_id, arg_min({'v':material}, pipe_id).v material, count(*) observations from pipes group by 1,2,3,4,5",
}

"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from tidemark.fixed_values import HOLIDAYS, ITEM_HISTORY_NAMES, RECENCY_EDGES

YEAR = 366 * 86400
TOKENS = 60
DIM = 64


def n(x: str) -> str:
    """Six digits, without negative zeros."""
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0e0 ELSE round({x}, 6) END"


def sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def signed_log1p(x: str) -> str:
    return f"(sign({x}) * ln(1e0 + abs({x})))"


def ln1p(x: str) -> str:
    return f"ln(1e0 + greatest({x}, 0e0))"


def clean(x: str, vocab: int) -> str:
    if vocab <= 0:
        return "0::BIGINT"
    return f"CASE WHEN {x} > 0 AND {x} < {vocab} THEN {x} ELSE 0 END"


def pad(xs: str, size: int, fill: str = "0", cast: str = "BIGINT[]") -> str:
    return f"list_resize(coalesce({xs}, []::{cast})[1:{size}], {size}, {fill})"


def pad_ids(xs: str, size: int, vocab: int) -> str:
    return f"list_transform({pad(xs, size)}, lambda x: {clean('x', vocab)})"


def text(xs: str) -> str:
    return f"coalesce(array_to_string({xs}, ','), '')"


def hour(ts: str, zone: int) -> str:
    return f"CASE WHEN {ts} > 0 THEN CAST(floor(({ts} + {zone}) / 3600.0) AS BIGINT) % 24 + 1 ELSE 0 END"


def weekday(ts: str, zone: int) -> str:
    return (
        f"CASE WHEN {ts} > 0 THEN (CAST(floor(({ts} + {zone}) / 86400.0) AS BIGINT) + 3) % 7 + 1"
        " ELSE 0 END"
    )


def period(ts: str, zone: int) -> str:
    h = f"(CAST(floor(({ts} + {zone}) / 3600.0) AS BIGINT) % 24)"
    return (
        f"CASE WHEN {ts} <= 0 THEN 0 WHEN {h} < 6 THEN 1 WHEN {h} < 11 THEN 2 WHEN {h} < 14 THEN 3"
        f" WHEN {h} < 18 THEN 4 WHEN {h} < 22 THEN 5 ELSE 6 END"
    )


def local_day(ts: str, zone: int) -> str:
    return f"CAST(floor(({ts} + {zone}) / 86400.0) AS BIGINT)"


HOLIDAY_LIST = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)


def weekend(ts: str, zone: int) -> str:
    return (
        f"CASE WHEN {ts} <= 0 THEN 0 WHEN ({local_day(ts, zone)} + 3) % 7 >= 5 THEN 2 ELSE 1 END"
    )


def holiday(ts: str, zone: int) -> str:
    return (
        f"CASE WHEN {ts} <= 0 THEN 0 WHEN (DATE '1970-01-01' + CAST({local_day(ts, zone)} AS INTEGER))"
        f" IN ({HOLIDAY_LIST}) THEN 2 ELSE 1 END"
    )


EDGES = "[" + ", ".join(str(e) for e in RECENCY_EDGES) + "]::BIGINT[]"


def recency(now: str, ts: str) -> str:
    age = f"greatest({now} - {ts}, 0)"
    below = f"len(list_filter({EDGES}, lambda e: e < {age}))"
    return f"CASE WHEN {ts} = 0 THEN 0 ELSE least({below}, {len(RECENCY_EDGES) - 1}) + 1 END"


ZONE = 8 * 3600

CTES = {
    "impressions": r"""
        SELECT event_id, user_id, CAST(regexp_extract(props, '\d+') AS BIGINT) + 1 AS item_id,
               CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
               CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 0 END
                   AS label_type,
               value
        FROM events""",
    "item_log": """
        SELECT l_partkey AS item_id, l_orderkey AS order_id, l_linenumber AS line_no,
               CAST(floor(epoch(l_shipdate)) AS BIGINT) AS "timestamp"
        FROM lineitem""",
    "ids": """
        SELECT event_id, user_id, item_id, "timestamp", label_type,
               CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value) AS BIGINT) % 50 - 5 END AS u1,
               item_id - 1 AS u2,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    WHEN event_id % 10 = 0 THEN []::BIGINT[]
                    ELSE [(item_id - 1) % 70, (item_id - 1) % 9 - 3, (item_id - 1) % 61,
                          CAST(floor(value) AS BIGINT) % 80, item_id - 1] END AS u3
        FROM impressions""",
    "holed": """
        SELECT vec_id, label, list_transform(embedding, lambda x, i:
                   CASE WHEN (vec_id + i - 1) % 17 = 0 THEN NULL
                        WHEN (vec_id + i - 1) % 19 = 0 THEN 'nan'::DOUBLE
                        WHEN (vec_id + i - 1) % 23 = 0 THEN 'inf'::DOUBLE
                        ELSE CAST(x AS DOUBLE) END) AS h
        FROM embeddings""",
    "dense": """
        SELECT vec_id, label,
               CASE WHEN vec_id % 50 <> 0 THEN h[1:24 - short] END AS d61,
               CASE WHEN vec_id % 50 <> 0 THEN h[25:40 - short] END AS d62,
               CASE WHEN vec_id % 50 <> 0 THEN h[41:64 - short] END AS d130
        FROM (SELECT *, CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS short FROM holed)""",
    "dense_raw": f"""
        SELECT vec_id, list_concat(list_concat({pad('d61', 24, 'NULL', 'DOUBLE[]')},
               {pad('d62', 16, 'NULL', 'DOUBLE[]')}), {pad('d130', 30, 'NULL', 'DOUBLE[]')}) AS r
        FROM dense""",
    "dense_rows": """
        SELECT vec_id,
               list_transform(r, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x)
                                                THEN 0e0 ELSE x END) AS v,
               list_transform(r, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x)
                                                THEN 0e0 ELSE 1e0 END) AS p
        FROM dense_raw""",
    "dense_pos": """
        SELECT vec_id, unnest(range(70)) AS pos, unnest(v) AS v, unnest(p) AS p FROM dense_rows""",
    "stats": f"""
        SELECT pos, count,
               coalesce(mean, 0e0) AS mean,
               CASE WHEN count <= 1 OR sd IS NULL OR sd < 1e-6 THEN 1e0 ELSE sd END AS std
        FROM (SELECT pos,
                     count(x) AS count, avg(x) AS mean, stddev_pop(x) AS sd
              FROM (SELECT pos, CASE WHEN p > 0 AND NOT (pos < 24 OR (pos >= 40 AND pos < 52))
                                     THEN {signed_log1p('v')} END AS x FROM dense_pos)
              GROUP BY pos)""",
    "histories": """
        SELECT event_id, user_id, item_id, "timestamp",
               list_reverse(coalesce(list(item_id) OVER w, [])) AS s38,
               list_reverse(coalesce(list(CAST(coalesce(label_type + 1, 0) AS BIGINT)) OVER w, [])) AS s39,
               list_reverse(coalesce(list("timestamp") OVER w, [])) AS s9
        FROM impressions
        WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id
                     ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)""",
    "padded": f"""
        SELECT event_id, user_id, "timestamp",
               {pad_ids('s38', 256, 101)} AS q38, {pad_ids('s39', 256, 4)} AS q39,
               {pad('s9', 256)} AS times, least(len(s38), 256) AS length
        FROM histories""",
    "scored": """
        SELECT event_id, user_id,
               CASE WHEN label_type = 2 THEN 1 ELSE 0 END AS label, (value - 245) / 100 AS logit
        FROM impressions""",
    "scored_nan": """
        SELECT event_id, user_id, label,
               CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE logit END AS logit
        FROM scored""",
    "freq": """
        SELECT token, count(*) AS cnt FROM (
            SELECT unnest(list_filter(s38, lambda x: x > 0)[1:200]) AS token FROM histories)
        GROUP BY token""",
    "vocab": f"""
        SELECT token AS raw_id, row_number() OVER (ORDER BY token) AS compact_id, cnt
        FROM (SELECT * FROM freq WHERE cnt >= 5 ORDER BY cnt DESC, token LIMIT {TOKENS})""",
    "known": """
        SELECT vec_id AS raw_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector
        FROM embeddings JOIN vocab ON raw_id = vec_id""",
}
CTE_ORDER = list(CTES)


def with_(needs: str, body: str) -> str:
    """Prefix a statement with the views it uses and those they are built from."""
    wanted: set[str] = set()
    todo = needs.split()
    while todo:
        name = todo.pop()
        if name in wanted:
            continue
        wanted.add(name)
        words = set(CTES[name].replace("(", " ").replace(")", " ").split())
        todo += [c for c in CTES if c in words and c != name]
    views = ",\n".join(f"{c} AS ({CTES[c]})" for c in CTE_ORDER if c in wanted)
    return f"WITH {views}\n{body}" if views else body


U1, U3 = clean("u1", 40), pad_ids("u3", 4, 60)
USER_INT = f"list_concat([{U1}, 0::BIGINT], {U3})"
ITEM_INT = f"[{clean('item_id', 101)}]"
TS = '"timestamp"'


def _calendar(zone: int) -> str:
    return with_(
        "impressions",
        f"SELECT event_id, CAST({hour(TS, zone)} AS INTEGER) AS hour,"
        f" CAST({weekday(TS, zone)} AS INTEGER) AS weekday,"
        f" {period(TS, zone)} AS period FROM impressions",
    )


def _cyclic(which: str, table: str) -> str:
    h, w = hour(TS, ZONE), weekday(TS, ZONE)
    angles = {
        "0": f"sin(({h} - 1) * 2 * pi() / 24)",
        "1": f"cos(({h} - 1) * 2 * pi() / 24)",
        "2": f"sin(({w} - 1) * 2 * pi() / 7)",
        "3": f"cos(({w} - 1) * 2 * pi() / 7)",
    }
    return angles[which]


def item_history_sql(log: str, where: str = "") -> tuple[str, str]:
    """Views for the twelve features over one log, and the final select."""
    views = f"""
    h_log AS (SELECT item_id, "timestamp" FROM {log} {where}),
    h_max AS (SELECT max("timestamp") AS m FROM h_log),
    h_core AS (SELECT item_id, count(*) AS c, min("timestamp") AS f, max("timestamp") AS l
               FROM h_log GROUP BY item_id),
    h_hour AS (SELECT item_id, "timestamp" // 3600 AS b, count(*) AS c FROM h_log GROUP BY 1, 2),
    h_day AS (SELECT item_id, "timestamp" // 86400 AS b, count(*) AS c FROM h_log GROUP BY 1, 2),
    h_hours AS (
        SELECT item_id, count(*) AS hours, max(c) AS peak, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS ent,
               sum(CASE WHEN b >= m // 3600 THEN c ELSE 0 END) AS c1,
               sum(CASE WHEN b >= m // 3600 - 5 THEN c ELSE 0 END) AS c6,
               sum(CASE WHEN b >= m // 3600 - 23 THEN c ELSE 0 END) AS c24
        FROM h_hour, h_max GROUP BY item_id),
    h_days AS (SELECT item_id, count(*) AS days, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS ent
               FROM h_day GROUP BY item_id),
    h_table AS (
        SELECT core.item_id,
               ln(1e0 + c) AS {ITEM_HISTORY_NAMES[0]},
               ln(1e0 + hours) AS {ITEM_HISTORY_NAMES[1]},
               CAST(days AS DOUBLE) AS {ITEM_HISTORY_NAMES[2]},
               peak / CAST(c AS DOUBLE) AS {ITEM_HISTORY_NAMES[3]},
               ln(1e0 + (l - f) / 3600e0) AS {ITEM_HISTORY_NAMES[4]},
               ln(1e0 + (m - l) / 3600e0) AS {ITEM_HISTORY_NAMES[5]},
               ln(1e0 + c1) AS {ITEM_HISTORY_NAMES[6]},
               ln(1e0 + c6) AS {ITEM_HISTORY_NAMES[7]},
               ln(1e0 + c24) AS {ITEM_HISTORY_NAMES[8]},
               CASE WHEN c24 > 0 THEN c1 / CAST(c24 AS DOUBLE) ELSE 0e0 END AS {ITEM_HISTORY_NAMES[9]},
               hs.ent AS {ITEM_HISTORY_NAMES[10]},
               ds.ent AS {ITEM_HISTORY_NAMES[11]}
        FROM h_core core JOIN h_hours hs USING (item_id) JOIN h_days ds USING (item_id), h_max)"""
    columns = ", ".join(f"{n(c)} AS {c}" for c in ITEM_HISTORY_NAMES)
    return views, columns


def item_history(log: str, where: str = "") -> str:
    views, columns = item_history_sql(log, where)
    return with_(log, "") .rstrip() + f",{views} SELECT item_id, {columns} FROM h_table"


def with_history(log: str, where: str, body: str) -> str:
    views, _ = item_history_sql(log, where)
    return with_(log, "").rstrip() + f",{views} {body}"


def attached(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{n(f'coalesce(t.{c}, 0e0)')} AS {c}" for c in columns)


def positions(view: str, xs: str, size: int, key: str = "vec_id", needs: str | None = None) -> str:
    return with_(
        needs or view,
        f"SELECT {key}, pos, {n('x')} AS value FROM (SELECT {key}, unnest(range({size})) AS pos,"
        f" unnest({xs}) AS x FROM {view})",
    )


BRANCH_CUTS = (("ud_fid61", 1, 24), ("ud_counts", 25, 40), ("ud_score", 41, 70))


def branches(transforms: dict[str, str]) -> str:
    parts = []
    for name, lo, hi in BRANCH_CUTS:
        xs = f"list_transform(v[{lo}:{hi}], lambda x: {transforms.get(name, 'x')})"
        parts.append(
            f"SELECT vec_id, pos, {n('x')} AS value, '{name}' AS branch FROM (SELECT vec_id,"
            f" unnest(range({hi - lo + 1})) AS pos, unnest({xs}) AS x FROM dense_rows)"
        )
    return with_("dense_rows", " UNION ALL ".join(parts))


SIZES = """
    sizes AS (
        SELECT max(u1) + 1 AS v1, max(list_max(u3)) + 1 AS v3, max(len(u3)) AS n3,
               max(item_id) + 1 AS v11 FROM ids),
    widths AS (SELECT max(len(d61)) AS n61, max(len(d62)) AS n62, max(len(d130)) AS n130 FROM dense)"""


def declared(n130: str) -> str:
    return f"""
    declared AS (
        SELECT 'user_int' AS "group", 0 AS slot, 1 AS fid, v1 AS vocab, 1 AS length FROM sizes
        UNION ALL SELECT 'user_int', 1, 2, 0, 1 FROM sizes
        UNION ALL SELECT 'user_int', 2, 3, v3, n3 FROM sizes
        UNION ALL SELECT 'item_int', 0, 11, v11, 1 FROM sizes
        UNION ALL SELECT 'user_dense', 0, 61, 0, n61 FROM widths
        UNION ALL SELECT 'user_dense', 1, 62, 0, n62 FROM widths
        UNION ALL SELECT 'user_dense', 2, 130, 0, {n130} FROM widths
        UNION ALL SELECT 'item_dense', 0, 129, 0, 1 FROM widths)"""


def with_sizes(body: str, n130: str = "n130") -> str:
    return with_("ids dense", "").rstrip() + f",{SIZES},{declared(n130)} {body}"


DECLARED_COLUMNS = (
    '"group", CAST(slot AS BIGINT) AS slot, CAST(fid AS BIGINT) AS fid,'
    " CAST(vocab AS BIGINT) AS vocab, CAST(length AS BIGINT) AS length"
)


def pooled(weights: str, floor: str) -> str:
    """Weighted mean of known vectors over the positions of a history."""
    return with_(
        "padded known",
        f"""
        , tokens AS (SELECT event_id, raw_id, w FROM (
                SELECT event_id, unnest(s38) AS raw_id, unnest({weights}) AS w
                FROM padded JOIN histories USING (event_id))),
        totals AS (SELECT event_id, coalesce(sum(w), 0e0) AS w
                   FROM padded LEFT JOIN tokens USING (event_id) GROUP BY event_id),
        sums AS (SELECT event_id, pos, sum(w * x) AS x FROM (
                     SELECT event_id, w, unnest(range({DIM})) AS pos, unnest(vector) AS x
                     FROM tokens JOIN known USING (raw_id)) GROUP BY event_id, pos),
        grid AS (SELECT event_id, w, unnest(range({DIM})) AS pos FROM totals)
        SELECT event_id, pos, {n(f'coalesce(x, 0e0) / greatest(w, {floor})')} AS value
        FROM grid LEFT JOIN sums USING (event_id, pos)""".lstrip(),
    )


def split_position(train_ratio: float, compat: bool) -> str:
    body = f"""
    , c AS (SELECT event_id, event_id // 700 AS chunk FROM impressions),
    t AS (SELECT max(chunk) + 1 AS n FROM c),
    v AS (SELECT n - greatest(1, CAST(floor(n * 0.1e0) AS BIGINT)) AS valid_start FROM t),
    e AS (SELECT valid_start,
                 {'greatest(1, CAST(floor(valid_start * %re0) AS BIGINT))' % train_ratio
                  if train_ratio < 1 else 'valid_start'} AS train_end FROM v)
    SELECT event_id, CASE WHEN chunk < train_end THEN 'train' ELSE 'valid' END AS split
    FROM c, e {'' if compat else 'WHERE chunk < train_end OR chunk >= valid_start'}"""
    return with_("impressions", body.strip())


def cutoff(log: str, ratio: float) -> str:
    q = (1.0 - ratio) * 100 / 100
    return f"""
    , r AS (SELECT "timestamp" AS ts, row_number() OVER (ORDER BY "timestamp") - 1 AS rk,
                   (count(*) OVER () - 1) * {q!r}::DOUBLE AS idx FROM {log}),
    b AS (SELECT max(CASE WHEN rk = floor(idx) THEN ts END) AS lo,
                 max(CASE WHEN rk = floor(idx) + 1 THEN ts END) AS hi,
                 max(idx) - floor(max(idx)) AS t FROM r),
    cut AS (SELECT CAST(floor(CASE WHEN t < 0.5 THEN lo + (coalesce(hi, lo) - lo) * t
                   ELSE coalesce(hi, lo) - (coalesce(hi, lo) - lo) * (1e0 - t) END) AS BIGINT) AS cutoff
            FROM b)"""


def contrastive(positives_only: bool) -> str:
    anchors = "WHERE partners > 0" + (" AND label = 1" if positives_only else "")
    return f"""
    WITH z AS (SELECT vec_id, vec_id // 100 AS block, label, list_transform(embedding,
                   lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding,
                       lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS v
               FROM embeddings),
    s AS (SELECT a.block, a.vec_id AS i, b.vec_id AS j, a.label AS label, a.label = b.label AS same,
                 list_dot_product(a.v, b.v) / 0.1e0 AS sim
          FROM z a JOIN z b ON a.block = b.block),
    m AS (SELECT i, max(sim) AS m FROM s GROUP BY i),
    d AS (SELECT i, ln(sum(CASE WHEN i <> j THEN exp(sim - m) ELSE 0e0 END) + 1e-12) AS lse
          FROM s JOIN m USING (i) GROUP BY i),
    a AS (SELECT block, i, label, sum(CASE WHEN same AND i <> j THEN 1 ELSE 0 END) AS partners,
                 sum(CASE WHEN same AND i <> j THEN sim - m - lse ELSE 0e0 END)
                     / greatest(sum(CASE WHEN same AND i <> j THEN 1 ELSE 0 END), 1) AS p
          FROM s JOIN m USING (i) JOIN d USING (i) GROUP BY block, i, label),
    k AS (SELECT block, count(*) AS anchors, -avg(p) AS loss FROM a {anchors} GROUP BY block)
    SELECT b.block, coalesce(anchors, 0) AS anchors, {n('coalesce(loss, 0e0)')} AS loss
    FROM (SELECT DISTINCT block FROM z) b LEFT JOIN k USING (block)"""


BCE = "(greatest(logit, 0e0) - logit * label + ln(1e0 + exp(-abs(logit))))"


def focal(alpha: float, gamma: float) -> str:
    p = sigmoid("logit")
    p_t = f"({p} * label + (1e0 - {p}) * (1 - label))"
    alpha_t = f"({alpha!r}::DOUBLE * label + {1 - alpha!r}::DOUBLE * (1 - label))"
    return f"{alpha_t} * pow(1e0 - {p_t}, {gamma!r}::DOUBLE) * {BCE}"


def auc_sql(view: str) -> str:
    """Rank formula with mid-ranks for ties."""
    return f"""
    r AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS rk
          FROM (SELECT label, {sigmoid('logit')} AS prob FROM {view})),
    a AS (SELECT sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) AS s, sum(label) AS p,
                 count(*) - sum(label) AS q FROM r)"""


AUC = "(s - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * q)"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    imp = "impressions"

    sql["read_impressions"] = with_(imp, "SELECT * FROM impressions")
    sql["project_scan"] = with_("item_log", f"SELECT item_id, {TS} FROM item_log")
    sql["union_files"] = (
        "SELECT doc_id, quality, NULL::BIGINT AS n_chars FROM labels"
        " UNION ALL SELECT doc_id, NULL::INTEGER, n_chars FROM documents"
    )
    sql["feature_schema"] = with_sizes(f"SELECT {DECLARED_COLUMNS} FROM declared", "30")
    sql["sequence_schema"] = with_sizes(
        """SELECT 'seq_a' AS domain, 'seq_a' AS prefix, 128::BIGINT AS max_len,
                  CAST(slot AS BIGINT) AS slot, CAST(fid AS BIGINT) AS fid,
                  CAST(vocab AS BIGINT) AS vocab, is_ts
           FROM (SELECT 0 AS slot, 38 AS fid, v11 AS vocab, 0 AS is_ts FROM sizes
                 UNION ALL SELECT 1, 39, 4, 0 FROM sizes UNION ALL SELECT -1, 9, 0, 1 FROM sizes)"""
    )
    sql["feature_layout"] = with_sizes(
        f"""SELECT {DECLARED_COLUMNS}, CAST(coalesce(sum(length) OVER (PARTITION BY "group" ORDER BY slot
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM declared"""
    )
    sql["validate_columns"] = with_("ids", f"SELECT event_id, {text(USER_INT)} AS user_int FROM ids")
    sql["write_examples"] = with_(
        "ids", f"SELECT event_id, {TS}, {text(USER_INT)} AS user_int, 'all' AS split FROM ids"
    )
    latest = with_(
        "scored",
        f"SELECT user_id, {n(sigmoid('arg_max(logit, event_id)'))} AS prob FROM scored GROUP BY user_id",
    )
    sql["latest_predictions"] = latest
    sql["write_predictions"] = latest
    stats = with_(
        "stats",
        f"SELECT CAST(pos AS BIGINT) AS pos, count, {n('mean')} AS mean, {n('std')} AS std FROM stats",
    )
    sql["dense_stats"] = stats
    sql["dense_stats_saved"] = stats
    positive = "lambda x: CASE WHEN x > 0 THEN x ELSE 0 END"
    observed = (
        "list_concat([CASE WHEN u1 > 0 THEN u1 ELSE 0 END, 0::BIGINT],"
        f" list_transform({pad('u3', 5)}, {positive}))"
    )
    sql["bundle_saved"] = (
        with_("ids dense padded", "").rstrip()
        + f""",{SIZES} SELECT event_id, {text(observed)} AS user_int, {text('[item_id]')} AS item_int,
            {text(f"{observed}[3:]")} AS second_group,
            CAST(n61 + n62 + n130 AS BIGINT) AS user_dense, 1::BIGINT AS item_dense,
            {text('q38')} AS items, {text('q39')} AS actions,
            '5.5 zscore ((''seq_a'', 38),) {len(HOLIDAYS)}' AS transform
            FROM ids JOIN (SELECT event_id, q38, q39 FROM padded) USING (event_id), widths"""
    )

    sql["filter_time_range"] = with_(
        imp,
        f"SELECT event_id, {TS} FROM impressions WHERE {TS} > 1704412800 AND {TS} <= 1705622400",
    )
    sql["derive_label"] = with_(
        imp,
        "SELECT event_id, CASE WHEN label_type = 2 THEN 1 ELSE 0 END AS label, 0 AS label_scoring"
        " FROM impressions",
    )
    sql["clean_id"] = with_(
        "ids", f"SELECT event_id, {U1} AS kept, 0::BIGINT AS no_vocab FROM ids"
    )
    sql["assert_in_vocab"] = with_("ids", "SELECT event_id, item_id FROM ids")
    sql["oob_report"] = with_(
        "ids",
        """SELECT "group", "column", count(*) AS oob_count, max(x) AS max_oob, min(x) AS min_oob, vocab
           FROM (SELECT 'user_int' AS "group", 'user_int_feats_1' AS "column", u1 AS x, 40::BIGINT AS vocab
                 FROM ids UNION ALL
                 SELECT 'user_int', 'user_int_feats_3', unnest(u3[1:4]), 60 FROM ids UNION ALL
                 SELECT 'item_int', 'item_int_feats_11', item_id, 101 FROM ids)
           WHERE x >= vocab GROUP BY "group", "column", vocab""",
    )
    sql["oob_report_sequences"] = with_(
        "histories",
        """SELECT 'seq_seq_a' AS "group", "column", count(*) AS oob_count, max(x) AS max_oob,
                  min(x) AS min_oob, vocab
           FROM (SELECT 'seq_a_38' AS "column", unnest(s38[1:256]) AS x, 90::BIGINT AS vocab FROM histories
                 UNION ALL SELECT 'seq_a_39', unnest(s39[1:256]), 3 FROM histories)
           WHERE x >= vocab GROUP BY "column", vocab""",
    )
    sql["drop_nan_scores"] = with_(
        "scored_nan",
        f"SELECT event_id, user_id, label, {n('logit')} AS logit FROM scored_nan WHERE NOT isnan(logit)",
    )
    sql["nan_score_count"] = with_(
        "scored_nan",
        "SELECT count(*) FILTER (WHERE isnan(logit)) AS dropped,"
        " count(*) FILTER (WHERE NOT isnan(logit)) AS kept FROM scored_nan",
    )

    sql["pad_int_list"] = with_(
        "ids",
        f"""SELECT event_id, {text(f"list_transform({pad('u3', 4)}, {positive})")} AS short,
            {text(f"list_transform({pad('u3', 7)}, {positive})")} AS long,
            CAST(least(coalesce(len(u3), 0), 4) AS BIGINT) AS length FROM ids""",
    )
    finite = "list_filter(d62, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))"
    sql["pad_float_list"] = positions("dense", pad(finite, 18, "0e0", "DOUBLE[]"), 18)
    bad = "lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN"
    head = pad("d61", 26, "NULL", "DOUBLE[]")
    sql["pad_float_list_with_presence"] = with_(
        "dense",
        f"""SELECT vec_id, pos, {n('v')} AS value, {n('p')} AS presence FROM (
            SELECT vec_id, unnest(range(26)) AS pos,
                   unnest(list_transform({head}, {bad} 0e0 ELSE x END)) AS v,
                   unnest(list_transform({head}, {bad} 0e0 ELSE 1e0 END)) AS p FROM dense)""",
    )
    sql["segment_presence"] = with_(
        "dense_rows",
        "SELECT vec_id, list_max(p[1:24]) AS head, list_max(p[65:70]) AS tail FROM dense_rows",
    )
    sql["append_presence"] = positions("dense_rows", "list_concat(v, p)", 140)
    sql["append_segment_presence"] = positions("dense_rows", "list_append(v, list_max(p))", 71)
    sql["take_range"] = positions("dense_rows", "list_resize(v[41:70], 40, 0e0)", 40)
    sql["assemble_int_vector"] = with_(
        "ids",
        f"SELECT event_id, {text(USER_INT)} AS user_int, {text(ITEM_INT)} AS item_int FROM ids",
    )
    sql["assemble_dense_vector"] = positions("dense_rows", "v", 70)
    sql["branch_vectors"] = branches({})
    sql["apply_branch_transform"] = branches(
        {"ud_counts": ln1p("x"), "ud_score": signed_log1p("x")}
    )
    sql["group_ids"] = with_(
        "ids",
        f"""SELECT event_id, {text(f'[{U1}, 0::BIGINT]')} AS u1, {text(U3)} AS u2,
            {text(f'[{U1}]')} AS single_1, {text(U3)} AS single_3 FROM ids""",
    )
    sql["build_sequence"] = with_(
        "padded", f"SELECT event_id, {text('q38')} AS items, {text('q39')} AS actions FROM padded"
    )
    sql["sequence_length"] = with_(
        "padded", "SELECT event_id, CAST(length AS BIGINT) AS length FROM padded"
    )
    sql["padding_mask"] = with_(
        "padded",
        f"""SELECT event_id, {text("list_transform(range(256), lambda i: CASE WHEN i >= length THEN 1 ELSE 0 END)")}
            AS mask FROM padded""",
    )
    sql["most_recent_k"] = with_(
        "padded",
        f"""SELECT event_id, {text("list_transform(range(20), lambda i: CASE WHEN i < length THEN q38[i + 1] ELSE 0 END)")}
            AS items,
            {text("list_transform(range(20), lambda i: CASE WHEN i >= least(length, 20) THEN 1 ELSE 0 END)")}
            AS mask FROM padded""",
    )
    kept = "list_filter(s39, lambda x: x > 0)"
    sql["valid_tokens"] = with_(
        "histories",
        f"SELECT event_id, {text(f'{kept}[1:15]')} AS tokens FROM histories WHERE len({kept}) > 0",
    )

    sql["calendar_ids"] = _calendar(ZONE)
    sql["calendar_ids_half_hour_zone"] = _calendar(-12600)
    shifted = f"({TS} + {YEAR})"
    sql["day_type"] = with_(
        imp,
        f"SELECT event_id, {weekend(shifted, ZONE)} AS weekend, {holiday(shifted, ZONE)} AS holiday"
        " FROM impressions",
    )
    sql["calendar_ids_seq"] = with_(
        "padded",
        "SELECT event_id, "
        + ", ".join(
            f"{text(f'list_transform(times, lambda t: {f})')} AS {name}"
            for name, f in (
                ("hour", hour("t", ZONE)),
                ("weekday", weekday("t", ZONE)),
                ("period", period("t", ZONE)),
            )
        )
        + " FROM padded",
    )
    later = f"list_transform(times, lambda t: CASE WHEN t > 0 THEN t + {YEAR} ELSE t END)"
    sql["day_type_seq"] = with_(
        "padded",
        f"""SELECT event_id, {text(f"list_transform(ts, lambda t: {weekend('t', ZONE)})")} AS weekend,
            {text(f"list_transform(ts, lambda t: {holiday('t', ZONE)})")} AS holiday
            FROM (SELECT event_id, {later} AS ts FROM padded)""",
    )
    sql["recency_bucket"] = with_(
        "padded",
        f"""SELECT event_id, {text(f"list_transform(times, lambda t: {recency(TS, 't')})")} AS buckets
            FROM padded""",
    )
    cyc = [_cyclic(str(i), imp) for i in range(4)]
    sql["cyclical_time"] = positions(imp, f"[{', '.join(cyc)}]", 4, "event_id")
    cal = f"[{hour(TS, ZONE)}, {weekday(TS, ZONE)}, {period(TS, ZONE)}]"
    sql["append_calendar"] = with_(
        "ids",
        f"SELECT event_id, {text(f'list_concat({USER_INT}, {cal})')} AS user_int,"
        f" {text(f'list_concat({ITEM_INT}, {cal})')} AS item_int, CAST(u2 AS DOUBLE) AS d0, "
        + ", ".join(f"{n(c)} AS d{i + 1}" for i, c in enumerate(cyc))
        + " FROM ids",
    )

    for name, f in (
        ("signed_log1p", signed_log1p("logit")),
        ("log1p_nonneg", ln1p("logit")),
        ("sigmoid", sigmoid("logit")),
    ):
        sql[name] = with_("scored", f"SELECT event_id, {n(f)} AS y FROM scored")
    sql["safe_ratio"] = with_(
        imp,
        f"""SELECT event_id, CASE WHEN item_id > 50 THEN value / (item_id - 50) ELSE 0e0 END AS y
            FROM impressions""",
    )
    sql["transform_mask"] = with_sizes(
        """SELECT pos, CASE WHEN pos < 24 OR (pos >= 40 AND pos < 52) THEN 0 ELSE 1 END AS scaled
           FROM (SELECT unnest(range(CAST(n61 + n62 + 30 AS BIGINT))) AS pos FROM widths)"""
    )
    sql["zscore_apply"] = with_(
        "dense_pos stats",
        f"""SELECT vec_id, pos, {n(f'''CASE WHEN p <= 0 THEN 0e0
                WHEN pos < 24 OR (pos >= 40 AND pos < 52) THEN v
                ELSE ({signed_log1p('v')} - mean) / std END''')} AS value
            FROM dense_pos JOIN stats USING (pos)""",
    )
    sql["hash_bucket"] = with_(
        "ids", "SELECT event_id, CASE WHEN u1 > 0 THEN u1 % 7 + 1 ELSE 0 END AS bucket FROM ids"
    )
    sql["route_by_cardinality"] = with_sizes(
        """SELECT "group", CAST(fid AS BIGINT) AS fid, CAST(vocab AS BIGINT) AS vocab,
                  CASE WHEN fid = 11 THEN 'word2vec' WHEN vocab <= 0 THEN 'skip'
                       WHEN vocab > 60 THEN 'hash' ELSE 'direct' END AS route,
                  CASE WHEN vocab > 45 THEN 1 ELSE 0 END AS is_id
           FROM declared WHERE "group" IN ('user_int', 'item_int')"""
    )

    sql["item_core_stats"] = with_(
        "item_log",
        f"""SELECT item_id, count(*) AS cnt, min({TS}) AS first_ts, max({TS}) AS last_ts,
            (SELECT max({TS}) FROM item_log) AS max_ts FROM item_log GROUP BY item_id""",
    )
    hours = f"SELECT item_id, {TS} // 3600 AS hour, count(*) AS cnt FROM impressions GROUP BY 1, 2"
    days = f"""SELECT item_id, {TS} // 86400 AS day, count(*) AS cnt,
               count(DISTINCT {TS} // 3600) AS hours FROM impressions GROUP BY 1, 2"""
    sql["item_hour_counts"] = with_(imp, hours)
    sql["item_day_counts"] = with_(imp, days)
    sql["item_active_buckets"] = with_(
        imp,
        f"""SELECT item_id, count(DISTINCT {TS} // 3600) AS active_hours,
            count(DISTINCT {TS} // 86400) AS active_days FROM impressions GROUP BY item_id""",
    )
    trailing = ", ".join(
        f"count(*) FILTER (WHERE {TS} // 3600 >= m // 3600 - {w - 1}) AS cnt_{w}h" for w in (1, 6, 24)
    )
    trail = f"""SELECT item_id, {trailing} FROM impressions,
        (SELECT max({TS}) AS m FROM impressions) GROUP BY item_id"""
    sql["item_trailing_counts"] = with_(imp, trail)
    sql["item_peak_ratio"] = with_(
        imp,
        f"""SELECT item_id, {n('max(cnt) / CAST(sum(cnt) AS DOUBLE)')} AS peak_ratio
            FROM ({hours}) GROUP BY item_id""",
    )
    sql["item_alive_recency"] = with_(
        "item_log",
        f"""SELECT item_id, {n(f'(max({TS}) - min({TS})) / 3600e0')} AS alive_hours,
            {n(f'((SELECT max({TS}) FROM item_log) - max({TS})) / 3600e0')} AS recency_hours
            FROM item_log GROUP BY item_id""",
    )
    sql["item_trend"] = with_(
        imp,
        f"""SELECT item_id, CASE WHEN cnt_24h > 0 THEN {n('cnt_1h / CAST(cnt_24h AS DOUBLE)')}
            ELSE 0e0 END AS trend FROM ({trail})""",
    )
    entropy = "ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt)"
    sql["bucket_entropy"] = with_(
        imp,
        f"""SELECT item_id, hour_entropy, day_entropy
            FROM (SELECT item_id, {n(entropy)} AS hour_entropy FROM ({hours}) GROUP BY item_id)
            JOIN (SELECT item_id, {n(entropy)} AS day_entropy FROM ({days}) GROUP BY item_id)
            USING (item_id)""",
    )
    sql["item_history_features"] = item_history(imp)
    sql["item_history_large"] = item_history("item_log")
    sql["item_history_in_range"] = item_history(
        imp, f"WHERE {TS} > 1704412800 AND {TS} <= 1705622400"
    )
    sql["token_frequency"] = with_("freq", "SELECT token, cnt FROM freq WHERE cnt >= 5")
    sql["auc"] = with_("scored", f", {auc_sql('scored').strip()} SELECT {n(AUC)} AS auc FROM a")
    sql["logloss"] = with_("scored", f"SELECT {n(f'avg({BCE})')} AS logloss FROM scored")
    sql["focal_loss"] = with_(
        "scored", f"SELECT {n(f'avg({focal(0.1, 2.0)})')} AS focal_loss FROM scored"
    )
    sql["focal_loss_per_row"] = with_(
        "scored", f"SELECT event_id, {n(focal(0.25, 1.5))} AS focal_loss FROM scored"
    )
    sql["pairwise_auc_loss"] = with_(
        "scored",
        f"""SELECT a.event_id // 1000 AS block, count(*) AS pairs,
            {n('avg(greatest(b.logit - a.logit, 0e0) + ln(1e0 + exp(-abs(b.logit - a.logit))))')} AS loss
            FROM scored a JOIN scored b ON a.event_id // 1000 = b.event_id // 1000
            WHERE a.label = 1 AND b.label = 0 GROUP BY 1""",
    )
    sql["contrastive_loss"] = contrastive(False)
    sql["contrastive_loss_positives"] = contrastive(True)
    early = (
        f"WHERE {TS} <= (SELECT min({TS}) + (max({TS}) - min({TS})) * 4 // 5 FROM impressions)"
    )
    sql["coverage"] = with_history(
        imp,
        early,
        f"""SELECT count(*) AS "rows", count(t.item_id) AS matched_rows,
            {n('count(t.item_id) / CAST(count(*) AS DOUBLE)')} AS coverage
            FROM impressions i LEFT JOIN h_core t USING (item_id)""",
    )
    sql["split_sizes"] = with_(
        imp,
        """, c AS (SELECT event_id // 300 AS chunk, count(*) AS k FROM impressions GROUP BY 1),
        t AS (SELECT max(chunk) + 1 AS n FROM c),
        s AS (SELECT k, CASE WHEN chunk < n - greatest(1, CAST(floor(n * 0.25e0) AS BIGINT))
                        THEN 'train' ELSE 'valid' END AS split FROM c, t)
        SELECT split, CAST(sum(k) AS BIGINT) AS "rows",
               CAST(ceil(sum(k) / 128e0) AS BIGINT) AS batches,
               CAST(sum(ceil(k / 128e0)) AS BIGINT) AS batches_by_chunk FROM s GROUP BY split""",
    )

    sql["attach_item_history"] = with_history(
        imp,
        early,
        f"""SELECT i.event_id, i.item_id, {attached(ITEM_HISTORY_NAMES)}
            FROM impressions i LEFT JOIN h_table t USING (item_id)""",
    )
    sql["attach_item_history_large"] = with_history(
        "item_log",
        "",
        f"""SELECT order_id, line_no, i.item_id, {attached(ITEM_HISTORY_NAMES)}
            FROM item_log i LEFT JOIN h_table t USING (item_id)""",
    )
    sql["top_k_vocab"] = with_("vocab", "SELECT raw_id, compact_id, cnt FROM vocab")
    sql["compact_ids"] = with_(
        "histories vocab",
        f""", e AS (SELECT event_id, unnest(range(len(s38))) AS pos, unnest(s38) AS raw_id FROM histories),
        g AS (SELECT event_id, list(coalesce(compact_id, 0) ORDER BY pos) AS xs
              FROM e LEFT JOIN vocab USING (raw_id) GROUP BY event_id)
        SELECT event_id, {text('xs')} AS items FROM histories LEFT JOIN g USING (event_id)""",
    )
    sql["compact_ids_shuffled"] = with_(
        "ids vocab",
        f""", e AS (SELECT event_id, unnest(range(len(u3))) AS pos, unnest(u3) AS raw_id FROM ids),
        g AS (SELECT event_id, list(coalesce(compact_id, 0) ORDER BY pos) AS xs
              FROM e LEFT JOIN vocab USING (raw_id) GROUP BY event_id)
        SELECT event_id, {text('xs')} AS items FROM ids LEFT JOIN g USING (event_id)""",
    )
    sql["embed_mean_pool"] = with_(
        "ids known",
        f""", e AS (SELECT event_id, unnest({U3}) AS raw_id FROM ids),
        c AS (SELECT event_id, count(*) FILTER (WHERE raw_id <> 0) AS k FROM e GROUP BY event_id),
        sums AS (SELECT event_id, pos, sum(x) AS x FROM (
                     SELECT event_id, unnest(range({DIM})) AS pos, unnest(vector) AS x
                     FROM e JOIN known USING (raw_id)) GROUP BY event_id, pos),
        grid AS (SELECT event_id, k, unnest(range({DIM})) AS pos FROM c)
        SELECT event_id, pos, {n('coalesce(x, 0e0) / greatest(k, 1)')} AS value
        FROM grid LEFT JOIN sums USING (event_id, pos)""",
    )
    sql["sequence_mean_pool"] = pooled("list_transform(s38, lambda x: 1e0)", "1e0")
    decay = f"exp(-0.1e0 * greatest({recency('padded.' + TS, 't')} - 1, 0))"
    sql["time_decay_pool"] = pooled(f"list_transform(s9, lambda t: {decay})", "1e-6")
    sql["holiday_lookup"] = with_(
        "item_log",
        f""", d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
                    WHERE o_orderpriority = '1-URGENT')
        SELECT order_id, line_no, CASE WHEN {TS} <= 0 THEN 0 WHEN day IS NULL THEN 1 ELSE 2 END AS holiday
        FROM item_log LEFT JOIN d ON day = DATE '1970-01-01' + CAST({TS} // 86400 AS INTEGER)""",
    )
    sql["range_lookup"] = with_(
        imp,
        f"""SELECT event_id, CAST({recency('m', TS)} AS INTEGER) AS age_bin, {period(TS, ZONE)} - 1 AS day_part
            FROM impressions, (SELECT max({TS}) AS m FROM impressions)""",
    )

    sql["split_by_position"] = split_position(1.0, False)
    sql["split_by_position_part"] = split_position(0.5, False)
    sql["split_by_position_compat"] = split_position(0.5, True)
    sql["split_by_time"] = with_(
        imp,
        cutoff(imp, 0.1).strip()
        + f" SELECT event_id, CASE WHEN {TS} <= cutoff THEN 'train' ELSE 'valid' END AS split"
        " FROM impressions, cut",
    )
    sql["time_cutoff"] = with_("item_log", cutoff("item_log", 0.3).strip() + " SELECT cutoff FROM cut")
    sql["shuffle_examples"] = with_(imp, "SELECT event_id, user_id FROM impressions")
    at = "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM impressions"
    sql["write_balanced"] = with_(
        imp,
        f""", p AS ({at}), c AS (SELECT pos // 300 AS chunk, count(*) AS n FROM p GROUP BY 1),
            d AS (SELECT chunk, (row_number() OVER (ORDER BY n DESC, chunk) - 1) % 7 AS shard FROM c)
        SELECT CAST(shard AS BIGINT) AS shard, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS events
        FROM p JOIN d ON chunk = pos // 300 GROUP BY 1""",
    )
    sql["shuffle_in_windows"] = with_(
        imp,
        f""", p AS ({at}), r AS (
            SELECT event_id, pos // 640 AS w, row_number() OVER (
                PARTITION BY pos // 640 ORDER BY md5(concat(pos // 640 + 42, ':3:', pos)), pos) - 1 AS r FROM p)
        SELECT event_id, CAST(w * 20 + r // 32 AS BIGINT) AS batch, CAST(r % 32 AS BIGINT) AS place FROM r""",
    )
    sql["limit_sentences"] = with_(
        "histories",
        f"""SELECT event_id, CAST(len({kept}[1:200]) AS BIGINT) AS n FROM histories
            WHERE len({kept}) > 0 ORDER BY event_id LIMIT 777""",
    )

    sql["histories"] = with_(
        "histories",
        f"""SELECT event_id, {text('s38')} AS items, {text('s39')} AS actions, {text('s9')} AS times
            FROM histories""",
    )
    sql["fit_item2vec"] = with_(
        "histories",
        f""", f AS (SELECT token, count(*) AS cnt FROM (
                 SELECT unnest(list_filter(s38, lambda x: x > 0)) AS token FROM histories)
             GROUP BY token HAVING count(*) >= 5)
        SELECT token AS raw_id, row_number() OVER (ORDER BY token) AS compact_id, 8::BIGINT AS dim FROM f
        UNION ALL SELECT 0, 0, 8""",
    )
    sql["item2vec_pairs"] = with_(
        "histories",
        f""", s AS (SELECT row_number() OVER () AS r, list_filter(s38, lambda x: x > 0) AS t FROM histories),
        e AS (SELECT r, unnest(range(len(t))) AS p, unnest(t) AS x FROM s),
        near AS (SELECT u.x AS a, v.x AS b FROM e u JOIN e v ON u.r = v.r AND v.p > u.p AND v.p <= u.p + 5),
        pairs AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY a, b),
        one AS (SELECT a, sum(n)::BIGINT AS k FROM pairs GROUP BY a)
        SELECT 'seq_a_38' AS feature, p.a, p.b, p.n,
            {n("greatest(ln(p.n * (SELECT sum(n)::BIGINT FROM pairs) / (CAST(x.k AS DOUBLE) * y.k)) - ln(2e0), 0e0)")} AS pmi
        FROM pairs p JOIN one x ON x.a = p.a JOIN one y ON y.a = p.b""",
    )
    sql["fit_item2vec_many"] = with_(
        "histories",
        f""", f AS (SELECT 'seq_a_38' AS feature, token, count(*) AS cnt FROM (
                 SELECT unnest(list_filter(s38, lambda x: x > 0)) AS token FROM histories)
             GROUP BY token HAVING count(*) >= 5),
        g AS (SELECT 'item_11' AS feature, item_id AS token, count(*) AS cnt FROM histories
             GROUP BY item_id HAVING count(*) >= 5)
        SELECT feature, token AS raw_id, row_number() OVER (PARTITION BY feature ORDER BY token)
               AS compact_id, 4::BIGINT AS dim FROM (SELECT * FROM f UNION ALL SELECT * FROM g)
        UNION ALL SELECT 'seq_a_38', 0, 0, 4 UNION ALL SELECT 'item_11', 0, 0, 4""",
    )
    sql["evaluate"] = with_(
        "scored_nan",
        f""", k AS (SELECT * FROM scored_nan WHERE NOT isnan(logit)), {auc_sql('k').strip()}
        SELECT {n(AUC)} AS auc, (SELECT {n(f'avg({BCE})')} FROM k) AS logloss FROM a""",
    )
    hist = ", ".join(
        f"{n(f'coalesce(t.{c}, 0e0)')} AS h{i}" for i, c in enumerate(ITEM_HISTORY_NAMES)
    )
    views, _ = item_history_sql(imp)

    def of_times(f: str) -> str:
        return text(f"list_transform(times, lambda t: {f})")

    no_values = "list_transform(range(70), lambda i: 0e0)"
    whole = f"""
        whole AS (SELECT ids.*, q38, q39, length, times, coalesce(v, {no_values}) AS v,
                         coalesce(CAST(d.label AS DOUBLE), 0e0) AS d129
                  FROM ids JOIN (SELECT event_id, q38, q39, length, times FROM padded) USING (event_id)
                  LEFT JOIN dense_rows d1 ON d1.vec_id = user_id LEFT JOIN dense d ON d.vec_id = user_id)"""
    sql["build_examples"] = (
        with_("ids padded dense_rows dense", "").rstrip()
        + f""",{views}, {whole.strip()} SELECT event_id, CASE WHEN label_type = 2 THEN 1 ELSE 0 END AS label,
            {text(f'list_concat({USER_INT}, {cal})')} AS user_int,
            {text(f"list_concat([{clean('whole.item_id', 101)}], {cal})")} AS item_int, {hist},
            {text("list_transform(v, lambda x: CAST(floor(x * 10000) AS BIGINT))")} AS user_dense,
            {", ".join(f"{n(c)} AS c{i}" for i, c in enumerate(cyc))}, d129,
            {hour(TS, ZONE)} AS now_hour, {text('q38')} AS seq_items, {text('q39')} AS seq_actions,
            CAST(length AS BIGINT) AS seq_len, {of_times(recency(TS, 't'))} AS seq_buckets,
            {of_times(hour('t', ZONE))} AS seq_hours, {of_times(weekday('t', ZONE))} AS seq_weekdays,
            {of_times(period('t', ZONE))} AS seq_periods, {of_times(weekend('t', ZONE))} AS seq_weekends,
            {of_times(holiday('t', ZONE))} AS seq_holidays
            FROM whole LEFT JOIN h_table t ON t.item_id = whole.item_id"""
    )

    # The design of a row, entry by entry; offsets follow the order of the blocks.
    def one_hot(offset: int, x: str) -> str:
        return f"SELECT event_id, {offset} + {x} AS i, 1e0 AS v FROM whole WHERE {x} > 0"

    def share(offset: int, xs: str, of: str, bucket: str) -> str:
        each = f"unnest(list_filter({xs}, lambda x: x > 0))"
        return f"SELECT event_id, {offset} + {bucket} AS i, 1e0 / w AS v FROM (SELECT event_id, {each} AS x, {of} AS w FROM whole)"

    hashed = "x % 16 + 1"
    item = clean("item_id", 101)
    marks = [hour(TS, ZONE), weekday(TS, ZONE), period(TS, ZONE)]
    known_ids = f"greatest(len(list_filter({U3}, lambda x: x > 0)), 1)"
    seen = "greatest(length, 1)"
    entries = [
        one_hot(0, f"({U1})"),
        share(41, U3, known_ids, hashed),
        f"SELECT event_id, 58 + ({item}) % 16 + 1, 1e0 FROM whole WHERE ({item}) > 0",
        *(one_hot(offset, f"({m})") for offset, m in zip((75, 100, 108, 115, 140, 148), marks * 2, strict=True)),
        share(155, "q38[1:length]", seen, hashed),
        share(172, "q39[1:length]", seen, "x"),
        "SELECT event_id, 177 + unnest(range(70)), unnest(v) FROM whole",
        *(f"SELECT event_id, {247 + k}, {c} FROM whole" for k, c in enumerate(cyc)),
        "SELECT event_id, 251, d129 FROM whole",
    ]
    # Each list with its own vocabulary: the most frequent ids, numbered in id order.
    compact = {"seq_a_38": ("s38", TOKENS), "seq_a_39": ("s39", 2), "user_int_feats_3": ("u3", 30)}
    views = ", ".join(
        f"""k_{x} AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (
                SELECT token FROM (SELECT unnest(list_filter({x}, lambda x: x > 0)) AS token FROM lists)
                GROUP BY token HAVING count(*) >= 5 ORDER BY count(*) DESC, token LIMIT {k})),
            m_{x} AS (SELECT map(list(token), list(id)) AS m FROM k_{x})"""
        for x, k in compact.values()
    )
    mapped = ", ".join(
        f"{text(f'list_transform({x}, lambda t: coalesce(m_{x}.m[t], 0))')} AS {c}" for c, (x, _) in compact.items()
    )
    sql["compact_ids_many"] = (
        with_("ids histories", "").rstrip()
        + f""", lists AS (SELECT event_id, s38[1:256] AS s38, s39[1:256] AS s39, u3 FROM ids JOIN (SELECT event_id, s38, s39 FROM histories)
                USING (event_id)), {views} SELECT event_id, {mapped} FROM lists, m_s38, m_s39, m_u3"""
    )

    sql["design_columns"] = (
        with_("ids padded dense_rows dense", "").rstrip()
        + f""", {whole.strip()}, entries AS ({" UNION ALL ".join(entries)}),
            cells AS (SELECT event_id, i, sum(v) AS v FROM entries GROUP BY event_id, i)
            SELECT CAST(i AS BIGINT) AS pos, count(*) AS n, {n('sum(v)')} AS total FROM cells
            WHERE abs(v) > 1e-9 GROUP BY i"""
    )
    sql["predict_as_trained"] = "SELECT event_id, 1 AS same FROM events"

    # Unpenalised one-hot groups: the fitted probability is the share observed in the group.
    groups = f"""
        g AS (SELECT event_id, user_id, {TS}, CASE WHEN label_type = 2 THEN 1 ELSE 0 END AS label,
                     CASE WHEN ({U1}) > 0 THEN ({U1}) % 6 + 1 ELSE 0 END AS k FROM ids)"""
    sql["fit_and_score_groups"] = (
        with_("ids", "").rstrip()
        + f""", {groups.strip()}, p AS (SELECT event_id, label, avg(label) OVER (PARTITION BY k) AS p FROM g)
            SELECT event_id, label, round(p, 4) AS prob, round(ln(p / (1 - p)), 4) AS logit FROM p"""
    )
    early = f"""{cutoff('ids', 0.2).strip()}, {groups.strip()},
        rates AS (SELECT k, avg(label) AS p FROM g, cut WHERE {TS} <= cutoff GROUP BY k)"""
    sql["train_and_evaluate_groups"] = (
        with_("ids", "").rstrip()
        + f"""{early}, late AS (SELECT label, p, ln(p / (1 - p)) AS logit FROM g JOIN rates USING (k), cut WHERE {TS} > cutoff),
            {auc_sql('late').strip().replace("r AS (", "ranks AS (").replace("FROM r)", "FROM ranks)")}
            SELECT round({AUC}, 4) AS auc, (SELECT round(avg({BCE}), 4) FROM late) AS logloss FROM a"""
    )
    sql["predict_groups"] = (
        with_("ids", "").rstrip()
        + f"""{early} SELECT user_id, round(arg_max(p, event_id), 4) AS prob FROM g JOIN rates USING (k) GROUP BY user_id"""
    )
    # A statement starting with a comma goes on with the views in front of it.
    return sql

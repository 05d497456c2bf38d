"""The SQL of op13_turn_repair: the same edits by a DP from the first turn on, each state with its audit and its lines."""

#: Cheapest of (cost, audit, lines) by cost, then audit; states: start, s, u, a.
_STEP = """
    struct_pack(
        z := CASE WHEN a.z.c < 1000000000 THEN struct_pack(c := a.z.c + 2, w := a.z.w || 'D', t := a.z.t) ELSE a.z END,
        s := list_min([{del_s}, {s}]), u := list_min([{del_u}, {u_z}, {u_s}, {u_u}, {u_a}]), a := list_min([{del_a}, {a_z}, {a_s}, {a_u}, {a_a}]))
"""


def _oracle() -> str:
    none = "struct_pack(c := 1000000000, w := '', t := '')"

    def delete(x: str) -> str:
        return f"struct_pack(c := a.{x}.c + 2, w := a.{x}.w || 'D', t := a.{x}.t)"

    def take(x: str, to: str, inserts: str, lines: str) -> str:
        cost = f"a.{x}.c + {5 * len(inserts)} + CASE WHEN e.cut THEN 5 ELSE 0 END"
        role = {"u": "user", "a": "assistant", "s": "system"}[to]
        keep = f"struct_pack(c := {cost}, w := a.{x}.w || '{inserts}K', t := a.{x}.t || '{lines}' || e.role || ':' || e.text || chr(10))"
        edit = none if to == "s" else f"struct_pack(c := {cost} + 1, w := a.{x}.w || '{inserts}R', t := a.{x}.t || '{lines}' || '{role}:' || e.text || chr(10))"
        return f"CASE WHEN NOT e.good THEN {none} WHEN e.initial = '{to}' THEN {keep} ELSE {edit} END"

    user, assistant = "user:' || chr(10) || '", "assistant:' || chr(10) || '"
    step = _STEP.format(
        del_s=delete("s"), del_u=delete("u"), del_a=delete("a"), s=take("z", "s", "", ""),
        u_z=take("z", "u", "", ""), u_s=take("s", "u", "", ""), u_u=take("u", "u", "I", assistant), u_a=take("a", "u", "", ""),
        a_z=take("z", "a", "I", user), a_s=take("s", "a", "I", user), a_u=take("u", "a", "", ""), a_a=take("a", "a", "I", user),
    )
    return rf"""
    WITH key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    chars AS (SELECT DISTINCT k, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM key),
    crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS fault FROM chars),
    hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM key JOIN crc USING (k) WHERE fault <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
    marked AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
        coalesce(right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?'), true) AS cut,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair FROM placed),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
        count(*) FILTER (cut AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list(struct_pack(initial := initial, role := role, text := text, good := NOT blank AND NOT seen, cut := cut) ORDER BY pos) AS es FROM marked GROUP BY conv_id),
    walked AS (SELECT * EXCLUDE (es), list_reduce(es, lambda a, e: {step.strip()},
        struct_pack(z := struct_pack(c := 0, w := '', t := ''), s := {none}, u := {none}, a := {none})) AS f FROM c),
    best AS (SELECT * EXCLUDE (f), list_min([f.z, f.a, struct_pack(c := f.u.c + 5, w := f.u.w || 'I', t := f.u.t || 'assistant:' || chr(10)),
        struct_pack(c := f.s.c + 10, w := f.s.w || 'II', t := f.s.t || 'user:' || chr(10) || 'assistant:' || chr(10))]) AS m FROM walked)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.w, '') AS audit, sha256(coalesce(m.t[:-2], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
    """


REPAIR = _oracle()

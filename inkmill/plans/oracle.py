"""The same semantics as SQL for DuckDB, built from small text pieces. No pattern looks around; matching is RE2's."""

from __future__ import annotations

from inkmill.functions import lexicon as lx

from .fixtures import values


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def bare(x: str) -> str:
    """A reply without code fences and thinking."""
    return strip(rf"regexp_replace(regexp_replace({x}, '```(json)?', '', 'g'), '(?s)<think>.*?</think>', '', 'g')")


def words(x: str) -> str:
    return rf"(CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] ELSE string_split_regex({strip(x)}, '\s+') END)"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def count_in(x: str, keywords: list[str]) -> str:
    return f"len(list_filter({items(keywords)}, lambda k: contains({x}, k)))"


def share(rows: str, test: str) -> str:
    return f"(CASE WHEN len({rows}) > 0 THEN len(list_filter({rows}, lambda l: {test})) / len({rows}) END)"


def toc_block(x: str) -> str:
    rows = lines(x)
    return f"(coalesce({has(f'lower({rows}[1])', lx.HEADER)}, false) OR coalesce({share(rows, has('l', lx.TOC_LINE))} > {lx.BLOCK_TOC}, false))"


def educational(x: str) -> str:
    bare, low = strip(x), f"lower({strip(x)})"
    task = items(lx.TASK_WORDS)
    return (
        f"NOT ({bare} = '' OR coalesce(list_contains({task}, {words(low)}[1]), false) OR len(list_distinct(list_intersect({words(low)}, {task}))) >= 3 OR {has(low, lx.HEADER)}"
        f" OR {has(bare, lx.COLOPHON)} OR {has(low, lx.PUBLICATION)} OR {has(bare, lx.TOC_LINE)} OR {toc_block(x)} OR {has(x, lx.TOC_INLINE)})"
    )


def clean_cte() -> str:
    """c(doc_id, cleaned) of documents."""
    noise = " OR ".join(has("l", p) for p in lx.LINE_NOISE)
    prepared = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\.{{3,}}', ' ', 'g'), '(\w)-\n(\w)', '\1\2', 'g')"
    a, b = "k[i - 1]", "k[i]"
    end, start = f"right({a}, 1)", f"left({b}, 1)"
    gap = (
        f"CASE WHEN i = 1 THEN '' WHEN {end} IN ('.', '!', '?') AND ({has(start, '[' + chr(92) + 'p{Lu}0-9]')} OR {start} IN ('•', '-', '*')) THEN chr(10) || chr(10)"
        f" WHEN {end} NOT IN ('.', '!', '?', ':') AND ({has(start, chr(92) + 'p{Ll}')} OR list_contains({items(lx.CONJUNCTIONS)}, lower({words(b)}[1]))) THEN ' ' ELSE chr(10) END"
    )
    return (
        f"k AS (SELECT doc_id, list_filter({lines(prepared)}, lambda l: NOT ({noise})) AS k FROM documents), "
        f"c AS (SELECT doc_id, {strip('regexp_replace(' + f'''coalesce(array_to_string(list_transform(range(1, len(k) + 1), lambda i: {gap} || {b}), ''), '')''' + ''', ' {2,}', ' ', 'g')''')} AS cleaned FROM k)"
    )


def paras_cte() -> str:
    """p(doc_id, para_no, text) of documents."""
    return clean_cte() + rf", p0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(cleaned, '\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM c), p AS (SELECT doc_id, unnest(range(len(ps)))::INT AS para_no, unnest(ps) AS text FROM p0)"


def score(s: str) -> str:
    tokens = words(s)
    n = f"len({tokens})"
    bad = " OR ".join(has(s, p) for p in (lx.BAD_START, r"^\d+", lx.FORMULA, lx.EMOJI_TWICE))
    return (
        f"(CASE WHEN {n} < 6 OR {bad} THEN -1.0::DOUBLE ELSE"
        f" (CASE WHEN {has(s, lx.DEFINITION)} THEN 10.0 WHEN {has(s, lx.CHARACTERISTIC)} THEN 5.0 WHEN {has(s, lx.PROCESS)} THEN 3.0 WHEN len(list_intersect({tokens}, {items(lx.BARE_DEFINERS)})) > 0 THEN 1.5 ELSE 0.0 END)"
        f" + (CASE WHEN {n} BETWEEN 10 AND 35 THEN 2.0 WHEN {n} BETWEEN 6 AND 9 THEN 0.5 WHEN {n} > 45 THEN -1.5 ELSE 0.0 END)"
        rf" + (CASE WHEN {has(s, chr(92) + '([A-Z]{2,}' + chr(92) + ')')} THEN 1.5 ELSE 0.0 END) + (CASE WHEN right({s}, 1) IN ('.', '!', '?') THEN 0.5 ELSE 0.0 END) END)::DOUBLE"
    )


def sents_cte(source: str = "documents") -> str:
    """s(doc_id, sent_no, sentence, n)."""
    return f"s0 AS (SELECT doc_id, {sentences('''coalesce(text, '')''')} AS ss FROM {source}), s1 AS (SELECT doc_id, unnest(range(len(ss)))::INT AS sent_no, unnest(ss) AS sentence FROM s0), s AS (SELECT *, {n_words('sentence')}::INT AS n FROM s1)"


def noise_unit(x: str) -> str:
    low = f"lower({strip(x)})"
    toc = f"coalesce({share(lines(x), has('l', lx.TOC_LINE))}, 0)"
    return (
        f"({n_words(low)} < 15 OR {count_in(f'''array_to_string({words(low)}[1:50], ' ')''', lx.NOISE_START)} > 0 OR {toc} > {lx.NOISE_TOC} OR {count_in(low, lx.GRATITUDE)} >= 2"
        f" OR {count_in(low, lx.COVER)} >= 3 OR {has(low, lx.PUBLICATION)})"
    )


def clean_option(x: str) -> str:
    bare = strip(x)
    n = n_words(bare)
    return f"({n} BETWEEN 3 AND 35 AND NOT {has(bare, lx.TOC_LINE)} AND NOT {has(bare, lx.COLOPHON)} AND NOT {has(f'lower({bare})', lx.PUBLICATION)} AND {count_in(f'lower({bare})', lx.STRUCTURAL)} = 0)"


def question_key(x: str) -> str:
    """Words stand between blanks in the rows it is used for, so boundaries of ASCII do."""
    out = strip(f"lower({x})")
    for pattern, by in lx.QUESTION_FORMS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(by)}, 'g')"
    return strip(rf"regexp_replace({out}, '\s+', ' ', 'g')")


def slang(x: str) -> str:
    """Runs of word characters are looked up; a blank before and after each run marks it off for the split."""
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in lx.SLANG.items()) + "}"
    pieces = rf"string_split(regexp_replace({x}, '(\w+)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    return f"coalesce(array_to_string(list_transform({pieces}, lambda p: coalesce({table}[lower(p)], p)), ''), '')"


DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"

def kind(x: str) -> str:
    return f"CASE WHEN {has(x, lx.DEFINITION)} THEN 'definition' WHEN {has(x, lx.CHARACTERISTIC)} THEN 'function' WHEN {has(x, lx.PROCESS)} THEN 'process' ELSE 'general' END"


TEMPLATES = "MAP {" + ", ".join(f"{q(k)}: {items(v)}" for k, v in lx.TEMPLATES.items()) + "}"

SQL: dict[str, str] = {
    "semantic_chunks": rf"""WITH RECURSIVE n AS (SELECT conv_id, turn, {strip('text')} AS body FROM conversations WHERE {n_words('text')} >= 10), b AS (SELECT conv_id, turn, {sentences('body')} AS ss FROM n WHERE {n_words('body')} > 120),
        s0 AS (SELECT conv_id, turn, unnest(range(len(ss))) AS i, unnest(ss) AS sentence FROM b), s AS (SELECT *, {n_words('sentence')} AS n FROM s0),
        r AS (SELECT conv_id, turn, i, n AS acc, 0 AS g FROM s WHERE i = 0
              UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN r.acc + s.n > 100 THEN s.n ELSE r.acc + s.n END, CASE WHEN r.acc + s.n > 100 THEN r.g + 1 ELSE r.g END FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.turn AND s.i = r.i + 1),
        p AS (SELECT conv_id, turn, g, string_agg(sentence, ' ' ORDER BY i) AS text FROM r JOIN s USING (conv_id, turn, i) GROUP BY conv_id, turn, g UNION ALL SELECT conv_id, turn, 0, body FROM n WHERE {n_words('body')} <= 120)
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, g) - 1)::INT AS chunk_id, text, ({n_words('text')} * 13 // 10)::INT AS n_tokens, (length(text) - length(translate(text, '.?!', '')))::INT AS n_sents, {n_words('text')}::INT AS word_count, 'semantic' AS method
        FROM p WHERE {n_words('text')} >= 10""",
    "question_prompts": f"""WITH k AS (SELECT id, correct, text, {kind('correct')} AS kind FROM {values('fx_defs')}), t AS (SELECT *, {TEMPLATES}[kind] AS ts FROM k)
        SELECT id, kind, replace(replace(replace(ts[id % len(ts) + 1], '{{answer}}', chr(1)), '{{context}}', {strip('text')}), chr(1), {strip('correct')}) AS prompt FROM t""",
    "llm_json_parse": rf"""WITH b AS (SELECT id, {bare('raw')} AS b FROM {values('fx_llm')}),
        j AS (SELECT id, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM b),
        d AS (SELECT *, list_filter(list_transform(list_filter(json_extract(j, '$.distractors[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: {strip("json_extract_string(x, '$')")}), lambda x: x <> '') AS d FROM j)
        SELECT id, nullif({strip("json_extract_string(j, '$.answer')")}, '') AS answer, CASE WHEN len(d) > 0 THEN d[1:3] END AS distractors FROM d""",
    "clean_blocks": f"WITH {clean_cte()} SELECT doc_id, cleaned FROM c",
    "paragraph_classes": f"""WITH {paras_cte()}, l AS (SELECT *, {lines('text')} AS ls FROM p),
        n AS (SELECT *, len(list_filter(ls, lambda l: {has('l', lx.BULLET)})) AS b, len(list_filter(ls, lambda l: {has('l', lx.NUMBER)})) AS m, len(list_filter(ls, lambda l: {has('l', lx.COMPLETE)})) AS f, greatest(len(ls), 1) AS t FROM l)
        SELECT doc_id, para_no, CASE WHEN b / t > 0.5 THEN 'bullet' WHEN m / t > 0.4 THEN 'numbered_list' WHEN f / t > 0.6 THEN 'structured' WHEN len(ls) <= 2 THEN 'heading' ELSE 'mixed' END AS type,
        b > 0 AS has_bullet, m > 0 AS has_numbered, {n_words('text')}::INT AS word_count FROM n""",
    "noise_documents": f"SELECT doc_id, {noise_unit('text')} AS is_noise FROM {DOCS}",
    "block_filters": f"""SELECT doc_id, {toc_block('text')} AS is_toc, {educational('text')} AS is_educational,
        NOT ({n_words('text')} < 20 OR {count_in('lower(text)', lx.CONTENT_SKIP)} >= 2 OR {toc_block('text')} OR {has('lower(text)', lx.PUBLICATION)}) AS is_content FROM {DOCS}""",
    "task_block_filter": f"""WITH l AS (SELECT *, CASE WHEN NOT ({educational('text')}) THEN 'N' WHEN {has('text', '^[•' + chr(92) + '-*]')} OR {has('text', '^[0-9]' + chr(92) + '.')} THEN 'L' ELSE 'P' END AS k FROM {values('fx_paras')}),
        m AS (SELECT *, last_value(CASE WHEN k <> 'L' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no) AS b FROM l)
        SELECT doc_id, para_no, text FROM m WHERE k <> 'N' AND NOT (k = 'L' AND coalesce(b = 'N', false))""",
    "merge_short_paragraphs": f"""WITH RECURSIVE {paras_cte()}, w AS (SELECT doc_id, para_no, {n_words('text')} AS n, max(para_no) OVER (PARTITION BY doc_id) AS final FROM p),
        r AS (SELECT doc_id, para_no, n AS acc, 0 AS g, final FROM w WHERE para_no = 0
              UNION ALL SELECT w.doc_id, w.para_no, CASE WHEN r.acc < 30 THEN r.acc + w.n ELSE w.n END, CASE WHEN r.acc < 30 THEN r.g ELSE r.g + 1 END, w.final FROM r JOIN w ON w.doc_id = r.doc_id AND w.para_no = r.para_no + 1),
        e AS (SELECT doc_id, acc, g FROM r WHERE para_no = final),
        m AS (SELECT r.doc_id, r.para_no, CASE WHEN r.g = e.g AND e.g > 0 AND e.acc < 30 THEN r.g - 1 ELSE r.g END AS g FROM r JOIN e USING (doc_id))
        SELECT doc_id, m.g::INT AS para_no, string_agg(text, ' ' ORDER BY m.para_no) AS text FROM m JOIN p USING (doc_id, para_no) GROUP BY doc_id, m.g""",
    "sentence_split": f"WITH {sents_cte()} SELECT doc_id, sent_no, sentence, n AS n_words, (n * 13 // 10)::INT AS n_tokens, (length(sentence) - length(translate(sentence, '.?!', '')))::INT AS n_marks FROM s",
    "sentence_filter": f"SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS text FROM (SELECT *, list_filter({sentences('text')}, lambda s: {n_words('s')} >= 6) AS k FROM {DOCS})",
    "answer_scores": f"WITH {sents_cte()} SELECT doc_id, sent_no, {score('sentence')} AS score FROM s",
    "pick_answer": f"""WITH {sents_cte()}, x AS (SELECT *, {score('sentence')} AS v FROM s)
        SELECT d.doc_id, coalesce(arg_min(sentence, n::BIGINT * 1000000 + sent_no) FILTER (v >= 10), arg_max(sentence, v * 1000000 - sent_no) FILTER (v >= 3), arg_max(sentence, v * 1000000 - sent_no) FILTER (v > 0)) AS answer
        FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id""",
    "sentence_chunks": f"""WITH RECURSIVE {sents_cte()}, t AS (SELECT doc_id, list(n * 13 // 10 ORDER BY sent_no) AS tk, list(sentence ORDER BY sent_no) AS ss, list(n ORDER BY sent_no) AS ns FROM s GROUP BY doc_id),
        u AS (SELECT *, list_transform(range(0, len(tk) + 1), lambda i: coalesce(list_sum(tk[1:i]), 0)) AS ps FROM t),
        r AS (SELECT doc_id, 0 AS cid, 0::BIGINT AS a, greatest(1, len(list_filter(range(1, len(tk) + 1), lambda e: ps[e + 1] <= 300))) AS e FROM u
              UNION ALL SELECT doc_id, cid + 1, st, greatest(st + 1, st + len(list_filter(range(st + 1, len(tk) + 1), lambda e: ps[e + 1] - ps[st + 1] <= 300)))
              FROM (SELECT r.doc_id, r.cid, u.tk, u.ps, greatest(r.a + 1, r.e - coalesce(list_min(list_filter(range(1, r.e - r.a + 1), lambda k: ps[r.e + 1] - ps[r.e - k + 1] >= 30)), r.e - r.a)) AS st FROM r JOIN u USING (doc_id)) WHERE st < len(tk))
        SELECT doc_id, cid::INT AS chunk_id, array_to_string(ss[a + 1:e], ' ') AS text, (ps[e + 1] - ps[a + 1])::INT AS n_tokens, (e - a)::INT AS n_sents, list_sum(ns[a + 1:e])::INT AS word_count FROM r JOIN u USING (doc_id)""",
    "split_large": f"""WITH RECURSIVE {sents_cte()}, r AS (SELECT doc_id, sent_no, n AS acc, 0 AS g FROM s WHERE sent_no = 0
              UNION ALL SELECT s.doc_id, s.sent_no, CASE WHEN r.acc + s.n > 100 THEN s.n ELSE r.acc + s.n END, CASE WHEN r.acc + s.n > 100 THEN r.g + 1 ELSE r.g END FROM r JOIN s ON s.doc_id = r.doc_id AND s.sent_no = r.sent_no + 1)
        SELECT doc_id, g::INT AS part, string_agg(sentence, ' ' ORDER BY sent_no) AS text FROM r JOIN s USING (doc_id, sent_no) GROUP BY doc_id, g""",
    "semantic_breaks": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT label, vec_id, 1 - list_cosine_similarity(lag(v) OVER (PARTITION BY label ORDER BY vec_id), v) AS distance FROM e),
        m AS (SELECT label, quantile_cont(distance, 0.5) AS lim FROM d GROUP BY label)
        SELECT label, vec_id, round(distance, 6) AS distance, sum(CASE WHEN distance > lim THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS segment FROM d JOIN m USING (label)""",
    "section_context": f"""WITH h AS (SELECT *, {n_words('text')} <= 12 AND NOT {has(strip('text'), lx.COMPLETE)} AS head FROM {values('fx_chunks')}),
        x AS (SELECT *, coalesce(last_value(CASE WHEN head THEN {strip('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id), '') AS sec FROM h)
        SELECT doc_id, chunk_id, CASE WHEN head OR sec = '' OR starts_with(text, left(array_to_string({words('sec')}[1:12], ' '), 15)) THEN text ELSE array_to_string({words('sec')}[1:12], ' ') || '. ' || text END AS text,
        CASE WHEN NOT head THEN sec END AS section FROM x""",
    "slang_normalise": f"SELECT id, {slang('text')} AS text FROM {values('fx_slang')}",
    "distractors_by_overlap": f"""WITH {sents_cte()}, x AS (SELECT *, {score('sentence')} AS v FROM s), a AS (SELECT doc_id, arg_max(sentence, v * 1000000 - sent_no) FILTER (v > 0) AS answer FROM x GROUP BY doc_id),
        c AS (SELECT doc_id, sent_no, lower(answer) AS low, CASE WHEN n > 35 THEN array_to_string({words('sentence')}[1:25], ' ') ELSE sentence END AS d FROM s JOIN a USING (doc_id) WHERE lower(sentence) <> lower(answer) AND NOT contains(lower(sentence), left(lower(answer), 30))),
        o AS (SELECT doc_id, d, len(list_distinct(list_intersect({words('lower(d)')}, {words('low')}))) AS o, {n_words('d')} AS w, sent_no FROM c WHERE {clean_option('d')}),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, d ORDER BY o DESC, w DESC, sent_no) AS same FROM o)
        SELECT doc_id, r::INT AS rank, d AS distractor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, w DESC, sent_no) - 1 AS r FROM f WHERE same = 1) WHERE r < 3""",
    "focused_context": f"""WITH {sents_cte()}, x AS (SELECT *, {score('sentence')} AS v FROM s), a AS (SELECT doc_id, arg_max(sentence, v * 1000000 - sent_no) FILTER (v > 0) AS answer FROM x GROUP BY doc_id),
        i AS (SELECT doc_id, coalesce(min(sent_no) FILTER (contains(lower(sentence), left({strip('lower(answer)')}, 50))), 0) AS hit FROM s JOIN a USING (doc_id) WHERE answer IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS context FROM s JOIN i USING (doc_id) WHERE sent_no BETWEEN hit - 3 AND hit + 3 GROUP BY doc_id""",
    "question_normalise": f"SELECT id, {question_key('text')} AS key FROM {values('fx_questions')}",
    "quiz_score": f"""WITH t AS (SELECT session, count(DISTINCT q_no)::INT AS total FROM {values('fx_quiz')} GROUP BY session), c AS (SELECT session, count(*) FILTER (selected = correct)::INT AS correct FROM {values('fx_submit')} GROUP BY session),
        j AS (SELECT session, coalesce(correct, 0) AS correct, total FROM t LEFT JOIN c USING (session)), p AS (SELECT *, CASE WHEN total > 0 THEN round_even(correct / total * 100, 0)::INT ELSE 0 END AS percent FROM j)
        SELECT session, correct, total, percent, CASE WHEN percent >= 85 THEN 'A' WHEN percent >= 70 THEN 'B' WHEN percent >= 55 THEN 'C' ELSE 'D' END AS grade FROM p""",
    "quiz_recap": f"""WITH l AS (SELECT session, q_no, arg_max(selected, seq) AS s FROM {values('fx_submit')} GROUP BY session, q_no)
        SELECT session, q_no, correct, coalesce(s, '-') AS selected, coalesce(s = correct, false) AS is_correct FROM {values('fx_quiz')} LEFT JOIN l USING (session, q_no)""",
    "choices_shuffled": f"""WITH a AS (SELECT id, answer, list_filter(pool, lambda p: lower(p) <> lower(answer)) AS pool FROM {values('fx_options')}),
        b AS (SELECT id, answer, list_concat(list_transform(list_sort(list_transform(pool, lambda p: md5(id::VARCHAR || '|' || p) || p)), lambda s: s[33:]), {items(lx.FALLBACK_OPTIONS)})[1:3] AS d FROM a),
        o AS (SELECT id, answer, list_transform(list_sort(list_transform(list_append(d, answer), lambda x: md5(id::VARCHAR || '|' || x) || x)), lambda s: s[33:]) AS o FROM b)
        SELECT id, o[1] AS option_a, o[2] AS option_b, o[3] AS option_c, o[4] AS option_d, (list_position(o, answer) - 1)::INT AS correct_idx FROM o""",
    "choices_retried": f"""WITH a AS (SELECT id, answer, list_filter(pool, lambda p: lower(p) <> lower(answer)) AS pool FROM {values('fx_options')}),
        b AS (SELECT id, answer, list_concat(list_transform(list_sort(list_transform(pool, lambda p: md5('1|' || id::VARCHAR || '|' || p) || p)), lambda s: s[33:]), {items(lx.FALLBACK_OPTIONS)})[1:3] AS d FROM a),
        o AS (SELECT id, answer, list_transform(list_sort(list_transform(list_append(d, answer), lambda x: md5('1|' || id::VARCHAR || '|' || x) || x)), lambda s: s[33:]) AS o FROM b)
        SELECT id, o AS options, (list_position(o, answer) - 1)::INT AS correct_idx FROM o""",
    "model_replies": rf"""WITH r AS (SELECT id, {bare('reply_a')} AS a, {bare('reply_b')} AS b FROM {values('fx_replies')}), b AS (SELECT id, CASE WHEN json_valid(a) THEN a::JSON END AS a, CASE WHEN json_valid(b) THEN b::JSON END AS b FROM r),
        d AS (SELECT id, {strip("json_extract_string(a, '$.answer')")} AS answer, json_type(a, '$.answer') AS kind,
              list_filter(list_transform(list_filter(json_extract(b, '$.distractors[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: {strip("json_extract_string(x, '$')")}), lambda x: x <> '')[1:3] AS d FROM b),
        m AS (SELECT id, coalesce(kind = 'VARCHAR' AND answer <> '' AND len(d) > 0, false) AS good, answer, d FROM d)
        SELECT id, CASE WHEN good THEN answer END AS answer, CASE WHEN good THEN list_concat(d, {items(lx.FALLBACK_OPTIONS)}[len(d) + 1:3]) END AS three FROM m""",
    "language_statistics": """SELECT d.lang, count(*) AS documents, sum(d.n_chars)::BIGINT AS chars, count(l.toxic) AS labelled, coalesce(sum(l.quality), 0)::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""",
}

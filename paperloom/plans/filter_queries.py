"""The functions and the language on the tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.values import Val
from paperloom.lang import render
from paperloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def made(name: str, of: str, key: str, template: str, presets: Mapping[str, str | Val], sql: str | None = None, html: str | None = None, where: str | None = None) -> None:
    """A query that renders ``template`` for each row of a table. ``presets``:
    variables as SQL expressions; ``sql`` the same for the whole result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        if where:
            df = df.where(where)
        values = {k: v if isinstance(v, Val) else Val(F.expr(v)) for k, v in presets.items()}
        return render(df, {"out": template}, values, html).select(key, "out")

    QUERIES[name] = query
    if sql:
        SQL[name] = f"SELECT {key}, {sql} AS out FROM {of}" + (f" WHERE {where}" if where else "")


PART = {"name": "p_name", "type": "p_type", "brand": "p_brand", "words": "concat(p_type, ' ', p_brand, ' ', p_name)"}
WORDS = "string_split(p_type || ' ' || p_brand || ' ' || p_name, ' ')"

made("f_upper", "part", "p_partkey", "{{name|upper}}", PART, "upper(p_name)")
made("f_lower", "part", "p_partkey", "{{type|lower}}", PART, "lower(p_type)")
made("f_capitalize", "part", "p_partkey", "{{type|capitalize}}", PART, "upper(left(p_type, 1)) || lower(substr(p_type, 2))")
made("f_kebab", "part", "p_partkey", "{{brand|kebab}} {{type|kebab}}", PART, r"lower(regexp_replace(regexp_replace(p_brand, '([a-z])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g')) || ' ' || lower(regexp_replace(regexp_replace(p_type, '([a-z])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g'))")
made("f_snake", "part", "p_partkey", "{{type|snake}}", PART, r"lower(regexp_replace(regexp_replace(p_type, '([a-z])([A-Z])', '\1_\2', 'g'), '[\s-]+', '_', 'g'))")
made("f_uncamel", "part", "p_partkey", "{{v|uncamel}}", {"v": "concat(replace(p_brand, '#', ''), 'HTMLPage')"}, r"lower(regexp_replace(regexp_replace(replace(p_brand, '#', '') || 'HTMLPage', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'))")
made("f_pascal", "part", "p_partkey", "{{v|pascal}}", {"v": "lower(p_type)"}, "list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', '')")
made("f_camel", "part", "p_partkey", "{{v|camel}}", {"v": "lower(p_type)"}, "lower(left(p_type, 1)) || substr(list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ''), 2)")
made("f_title", "part", "p_partkey", "{{v|title}}", {"v": "concat(p_type, ' OF THE ', p_name)"}, "list_aggregate(list_transform(string_split(p_type || ' OF THE ' || p_name, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('a','an','the','and','but','or','for','nor','on','at','to','from','by','in','of') THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), 'string_agg', ' ')")
made("f_trim", "part", "p_partkey", "[{{v|trim}}]", {"v": "concat(' \\t ', p_name, ' \\n')"}, r"'[' || regexp_replace(' ' || chr(9) || ' ' || p_name || ' ' || chr(10), '^\s+|\s+$', '', 'g') || ']'")
made("f_replace_literal", "part", "p_partkey", '{{type|replace:"A":"4","E":"3"}}', PART, "replace(replace(p_type, 'A', '4'), 'E', '3')")
made("f_replace_regex", "part", "p_partkey", '{{type|replace:"/[AEIOU]+/g":"_","/([A-Z])_/":"<$1>"}}', PART, r"regexp_replace(regexp_replace(p_type, '[AEIOU]+', '_', 'g'), '([A-Z])_', '<\1>')")
made("f_safe_name", "reader_pages", "page_id", "{{v|safe_name}}", {"v": "concat('.', title, ': a/b? [x]')"}, r"""regexp_replace(regexp_replace('.' || title || ': a/b? [x]', '[#|\^\[\]<>:"/\\?*\x00-\x1F]', '', 'g'), '^\.', '_')""")
made("f_decode_uri", "nation", "n_nationkey", "{{a|decode_uri}} {{b|decode_uri}}", {"a": "concat('a%20b+', n_name)", "b": "concat('100%', n_name)"}, "'a b+' || n_name || ' 100%' || n_name")
made("f_unescape", "nation", "n_nationkey", "{{v|unescape}}", {"v": "concat(n_name, '\\\\\"q\\\\\"', '\\\\n', 'x')"}, "n_name || '\"q\"' || chr(10) || 'x'")
made("f_blockquote", "documents", "doc_id", "{{v|blockquote}}", {"v": "text"}, "list_aggregate(list_transform(string_split(text, chr(10)), lambda x: '> ' || x), 'string_agg', chr(10))")
made("f_callout", "part", "p_partkey", '{{name|callout:("tip","About",true)}}', PART, "'> [!tip]- About' || chr(10) || '> ' || p_name")
made("f_footnote", "part", "p_partkey", '{{words|split:" "|footnote}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x, i: '[^' || i || ']: ' || x), 'string_agg', chr(10) || chr(10))")
made("f_fragment_link", "nation", "n_nationkey", '{{v|fragment_link|first}}', {"v": "concat(n_name, ' is a nation')", "url": "'https://x.test/p'"}, "n_name || ' is a nation [link](https://x.test/p#:~:text=' || replace(n_name, ' ', '%20') || '%20is%20a%20nation)'")
made("f_image", "part", "p_partkey", '{{words|split:" "|image:"alt"}}', PART, f"to_json(list_transform({WORDS}, lambda x: '![alt](' || x || ')'))::VARCHAR")
made("f_link", "part", "p_partkey", '{{name|link:"see"}}', PART, "'[see](' || replace(p_name, ' ', '%20') || ')'")
made("f_wikilink", "part", "p_partkey", '{{words|split:" "|wikilink:"w"}}', PART, f"to_json(list_transform({WORDS}, lambda x: '[[' || x || '|w]]'))::VARCHAR")
made("f_list_bullet", "part", "p_partkey", '{{words|split:" "|list}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x: '- ' || x), 'string_agg', chr(10))")
made("f_list_numbered", "part", "p_partkey", '{{words|split:" "|list:numbered}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x, i: i || '. ' || x), 'string_agg', chr(10))")
made("f_list_task", "part", "p_partkey", '{{words|split:" "|list:task}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x: '- [ ] ' || x), 'string_agg', chr(10))")
made("f_list_numbered_task", "part", "p_partkey", '{{words|split:" "|list:numbered-task}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x, i: i || '. [ ] ' || x), 'string_agg', chr(10))")
made("f_table", "events", "event_id", "{{props|table}}", {"props": "props"}, "'| k | ' || json_extract_string(props, '$.k') || ' |' || chr(10) || '| - | - |'")
made("f_table_list", "part", "p_partkey", '{{words|split:" "|table}}', PART, f"'| Value |' || chr(10) || '| - |' || chr(10) || list_aggregate(list_transform({WORDS}, lambda x: '| ' || x || ' |'), 'string_agg', chr(10))")
made("f_calc", "part", "p_partkey", '{{v|calc:"*2.5"|calc:"+1"}}', {"v": "cast(p_size as string)"}, "CASE WHEN p_size % 2 = 0 THEN (p_size * 5 // 2 + 1)::VARCHAR ELSE (p_size * 5 // 2 + 1)::VARCHAR || '.5' END")
made("f_round", "part", "p_partkey", "{{a|round}} {{b|round}}", {"a": "cast(p_size / 4 as string)", "b": "cast(-p_size / 4 as string)"}, "floor(p_size / 4.0 + 0.5)::BIGINT::VARCHAR || ' ' || floor(-p_size / 4.0 + 0.5)::BIGINT::VARCHAR")
made("f_number_format", "orders", "o_orderkey", '{{v|number_format:(2,",",".")}}', {"v": "cast(cast(o_totalprice as bigint) as string)"}, "replace(format('{:,}', trunc(o_totalprice)::BIGINT), ',', '.') || ',00'")
made("f_length", "documents", "doc_id", "{{v|length}}", {"v": "concat('x', text)"}, r"(length(text) + 1 + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::VARCHAR")
made("f_split_join", "part", "p_partkey", '{{words|split:" "|join:"-"}}', PART, "replace(p_type || ' ' || p_brand || ' ' || p_name, ' ', '-')")
made("f_join_default", "part", "p_partkey", '{{words|split:" "|join}}', PART, "replace(p_type || ' ' || p_brand || ' ' || p_name, ' ', ',')")
made("f_slice_str", "part", "p_partkey", "{{name|slice:1,5}}|{{name|slice:-3}}", PART, "substr(p_name, 2, 4) || '|' || right(p_name, 3)")
made("f_slice_arr", "part", "p_partkey", '{{words|split:" "|slice:0,2}}', PART, f"to_json(list_slice({WORDS}, 1, 2))::VARCHAR")
made("f_nth_kn", "part", "p_partkey", '{{v|split:"|"|nth:2n|join:"+"}}', {"v": "concat(p_name, '|', p_type, '|', p_brand, '|', p_name)"}, "p_type || '+' || p_name")
made("f_nth_basis", "part", "p_partkey", '{{v|split:"|"|nth:1,2:3|join:"+"}}', {"v": "concat(p_name, '|', p_type, '|', p_brand, '|', p_name)"}, "p_name || '+' || p_type || '+' || p_name")
made("f_nth_offset", "part", "p_partkey", '{{v|split:"|"|nth:n+3|join:"+"}}', {"v": "concat(p_name, '|', p_type, '|', p_brand, '|', p_name)"}, "p_brand || '+' || p_name")
made("f_first", "part", "p_partkey", '{{words|split:" "|first}}', PART, f"{WORDS}[1]")
made("f_last", "part", "p_partkey", '{{words|split:" "|last}}', PART, f"{WORDS}[-1]")
made("f_unique", "part", "p_partkey", '{{v|split:"|"|unique|join:"|"}}', {"v": "concat(p_brand, '|', p_name, '|', p_brand, '|', p_name)"}, "p_brand || '|' || p_name")
made("f_reverse_arr", "part", "p_partkey", '{{words|split:" "|reverse|join:" "}}', PART, f"list_aggregate(list_reverse({WORDS}), 'string_agg', ' ')")
made("f_reverse_str", "part", "p_partkey", "{{name|reverse}}", PART, "reverse(p_name)")
made("f_merge", "part", "p_partkey", '{{words|split:" "|merge:("a","b c")|join:","}}', PART, "replace(p_type || ' ' || p_brand || ' ' || p_name, ' ', ',') || ',a,b c'")
made("f_object_keys", "events", "event_id", "{{props|object:keys}}", {"props": "props"}, "to_json(json_keys(props))::VARCHAR")
made("f_object_values", "events", "event_id", "{{props|object:values}}", {"props": "props"}, "'[' || json_extract(props, '$.k')::VARCHAR || ']'")
made("f_object_array", "events", "event_id", "{{props|object:array}}", {"props": "props"}, "'[[\"k\",' || json_extract(props, '$.k')::VARCHAR || ']]'")
made("f_map_literal", "part", "p_partkey", '{{words|split:" "|map:x => "<${x}>"|join:""}}', PART, f"list_aggregate(list_transform({WORDS}, lambda x: '<' || x || '>'), 'string_agg', '')")
made("f_map_member", "events", "event_id", '{{v|map:x => x.k|join:"/"}}', {"v": "concat('[', props, ',{\"k\":7}]')"}, "json_extract_string(props, '$.k') || '/7'")
made("f_map_object", "events", "event_id", "{{v|map:x => ({id: x.k, c: 'z'})|first}}", {"v": "concat('[', props, ']')"}, "'{\"id\":\"' || json_extract_string(props, '$.k') || '\",\"c\":\"z\"}'")
made("f_map_template", "events", "event_id", '{{v|template:"k is ${k}\\n\\nend"}}', {"v": "concat('[', props, ',', props, ']')"}, "'k is ' || json_extract_string(props, '$.k') || chr(10) || 'end' || chr(10) || chr(10) || 'k is ' || json_extract_string(props, '$.k') || chr(10) || 'end'")
made("f_date", "orders", "o_orderkey", '{{d|date:"DD/MM/YYYY"}} {{d|date:"MMMM D, YYYY"}}', {"d": "date_format(o_orderdate, 'yyyy-MM-dd')"}, "strftime(o_orderdate, '%d/%m/%Y') || ' ' || strftime(o_orderdate, '%B %-d, %Y')")
made("f_date_input", "orders", "o_orderkey", '{{d|date:"YYYY-MM-DD","DD.MM.YYYY"}}', {"d": "date_format(o_orderdate, 'dd.MM.yyyy')"}, "strftime(o_orderdate, '%Y-%m-%d')")
made("f_date_week", "orders", "o_orderkey", '{{d|date:"YYYY [week] WW [of] Q, Do"}}', {"d": "date_format(o_orderdate, 'yyyy-MM-dd')"}, "strftime(o_orderdate, '%Y week ') || lpad(week(o_orderdate)::VARCHAR, 2, '0') || ' of ' || quarter(o_orderdate) || ', ' || day(o_orderdate) || CASE WHEN day(o_orderdate) IN (11,12,13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END")
made("f_date_modify", "orders", "o_orderkey", '{{d|date_modify:"+1 month"}} {{d|date_modify:"-2 weeks"}}', {"d": "date_format(o_orderdate, 'yyyy-MM-dd')"}, "strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') || ' ' || strftime(o_orderdate::DATE - INTERVAL 14 DAY, '%Y-%m-%d')")
made("f_duration", "part", "p_partkey", "{{a|duration}} {{b|duration}}", {"a": "cast(p_size * 137 as string)", "b": "concat('PT', p_size, 'M5S')"}, "CASE WHEN p_size * 137 >= 3600 THEN lpad((p_size * 137 // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((p_size * 137 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((p_size * 137 % 60)::VARCHAR, 2, '0') || ' ' || lpad(p_size::VARCHAR, 2, '0') || ':05'")
made("f_strip_attr", "reader_pages", "page_id", "{{v|strip_attr}}", {"v": "reader_html"}, r"coalesce(regexp_replace(reader_html, '<(\w+)\s+[^>]*?>', '<\1>', 'g'), '')")
made("f_strip_attr_keep", "reader_pages", "page_id", '{{v|strip_attr:("href")}}', {"v": "reader_html"})
made("f_remove_tags", "reader_pages", "page_id", '{{v|remove_tags:("a","b")}}', {"v": "reader_html"}, r"coalesce(regexp_replace(reader_html, '(?i)</?(?:a|b)\b[^>]*>', '', 'g'), '')")
made("f_replace_tags", "reader_pages", "page_id", '{{v|replace_tags:"h1":"h2"}}', {"v": "reader_html"}, r"coalesce(regexp_replace(regexp_replace(reader_html, '<h1(\s+[^>]*?)?>', '<h2\1>', 'g'), '</h1>', '</h2>', 'g'), '')")
made("f_remove_attr", "reader_pages", "page_id", '{{v|remove_attr:("data-b")}}', {"v": "reader_html"}, r"""coalesce(regexp_replace(reader_html, ' data-b="\d+"', '', 'g'), '')""")
made("f_strip_tags", "reader_pages", "page_id", "{{v|strip_tags}}", {"v": "reader_html"})
made("f_strip_md", "documents", "doc_id", "{{v|strip_md}}", {"v": "text"})
made("f_stripmd", "documents", "doc_id", "{{v|stripmd}}", {"v": "text"})
made("f_remove_html", "reader_pages", "page_id", '{{v|remove_html:("a","#x",".y")}}', {"v": "reader_html"})
made("f_html_to_json", "reader_pages", "page_id", "{{v|html_to_json}}", {"v": "reader_html"})
made("f_markdown", "reader_pages", "page_id", "{{v|markdown}}", {"v": "reader_html", "url": "url"})

# the language
made("tl_output", "nation", "n_nationkey", "# {{ name | lower }}\n{{missing}}.", {"name": "n_name"}, "'# ' || lower(n_name) || chr(10) || '.'")
made("tl_if_elseif", "part", "p_partkey", "{% if size > 30 %}large{% elseif size >= 10 and size != 20 %}medium{% else %}small{% endif %}", {"size": "cast(p_size as double)"}, "CASE WHEN p_size > 30 THEN 'large' WHEN p_size >= 10 AND p_size <> 20 THEN 'medium' ELSE 'small' END")
made("tl_for_loop", "part", "p_partkey", '{% for w in words %}{{loop.index}}/{{loop.length}} {{w|lower}}{% if loop.last %}.{% endif %}{% endfor %}', {"words": "to_json(split(concat(p_type, ' ', p_brand, ' ', p_name), ' '))"}, f"list_aggregate(list_transform({WORDS}, lambda w, i: i || '/' || len({WORDS}) || ' ' || lower(w) || CASE WHEN i = len({WORDS}) THEN '.' ELSE '' END), 'string_agg', chr(10))")
made("tl_nullish", "reader_pages", "page_id", '{{ author ?? description ?? "nobody" }}', {"author": "author", "description": "description"}, "coalesce(nullif(author, ''), nullif(description, ''), 'nobody')")
made("tl_contains", "part", "p_partkey", '{% if type contains "brass" or name contains "A" %}y{% else %}n{% endif %}', PART, "CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_name), 'a') THEN 'y' ELSE 'n' END")
made("tl_set", "part", "p_partkey", "{% set v = type|lower %}\n{% set name = 'x' %}\n{{v}} {{name}}", PART, "lower(p_type) || ' ' || p_name")
made("tl_not_equal", "orders", "o_orderkey", '{% if not (status == "F") %}open{% endif %}|{% if status == missing %}x{% endif %}', {"status": "o_orderstatus"}, "CASE WHEN o_orderstatus <> 'F' THEN 'open' ELSE '' END || '|'")
made("tl_member", "events", "event_id", '{{props["k"]}} {{props.k}} {{list[1]}}', {"props": "props", "list": "concat('[1,\"', event_type, '\"]')"}, "json_extract_string(props, '$.k') || ' ' || json_extract_string(props, '$.k') || ' ' || event_type")
made("tl_whitespace", "nation", "n_nationkey", "a{% if name == 'CHINA' %}\n\nC{% endif %}   \nb", {"name": "n_name"}, "'a' || CASE WHEN n_name = 'CHINA' THEN chr(10) || chr(10) || 'C' ELSE '' END || 'b'")
made("tl_parse_error", "nation", "n_nationkey", "a {{ name | }} b", {"name": "n_name"}, "''")
made("tl_unknown_filter", "nation", "n_nationkey", "{{name|nosuchfilter:3|lower}}", {"name": "n_name"}, "lower(n_name)")
made("tl_prompt", "nation", "n_nationkey", 'x{{"summarise this"}}y', {"name": "n_name"}, "'xy'")
made("tl_selector", "reader_pages", "page_id", '{{selector:h1|first}} {{selector:a?href|length}}', {}, None, "reader_html")

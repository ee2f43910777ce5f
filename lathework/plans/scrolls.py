"""Queries over texts, patches and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions import coerce, lines, patch, reports, text, usage, verdicts
from lathework.operators import dedup, enrich, planning
from lathework.plans import views
from lathework.plans.catalogue import SQL, query
from lathework.runtime import table


def _items(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "materialized_items").filter("instance_id is not null").select("instance_id", *columns).distinct()


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", "text", *columns)


def _edges(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


# --- texts -------------------------------------------------------------------------------

_BLOCK = r"regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array({c}, '\r\n|\n|\r'), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"
_LINE = r"regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(sql=f"select doc_id, sha256({_BLOCK.format(c='text')}) as block from documents where text is not null")
def block_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with single spaces and blank lines, by their hash."""
    return _docs(spark, sf).select("doc_id", F.sha2(lines.block_text("text"), 256).alias("block"))


@query(sql=f"""
 with i as (select distinct instance_id, coalesce(problem_statement, '') as s, coalesce(reason, '') as advice, coalesce(commit_sha, '') as subject, length(instance_id) as n from materialized_items where instance_id is not null),
 t as (select instance_id, {_BLOCK.format(c="case when n % 3 = 0 then s else '' end")} as issue, {_BLOCK.format(c="case when n % 3 = 1 then s else '' end")} as pull, {_BLOCK.format(c='advice')} as advice, {_LINE.format(c='subject')} as subject from i)
 select instance_id, case when issue <> '' then 'linked_issue' when pull <> '' then 'pull_request' when advice <> '' and subject <> '' then 'llm_advisory' when advice <> '' then 'llm_advisory' else 'commit' end as source,
  length(case when issue <> '' then issue when pull <> '' then pull when advice <> '' then advice else subject end) as n_chars from t""")
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Statements from an issue, else a pull request, else advice on a weak commit, else the commit."""
    rows = _items(spark, sf, "problem_statement", "reason", "commit_sha")
    n, s, none = F.length("instance_id") % 3, F.coalesce("problem_statement", F.lit("")), F.lit("")
    told = lines.statement(none, F.when(n == 0, s).otherwise(""), none, F.when(n == 1, s).otherwise(""), F.coalesce("reason", none), F.coalesce("commit_sha", none), none)
    return rows.select("instance_id", told["source"].alias("source"), F.length(told["text"]).alias("n_chars"))


@query(sql=r"""
 select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(replace(text, ';', ' '), '[\s,]+'), lambda x: x <> ''), lambda x: case when regexp_extract(lower(x), '^py\d(\d\d)$', 1) <> '' then '3.' || regexp_extract(lower(x), '^py\d(\d\d)$', 1)
   when x not like '<%' then regexp_extract(x, '^(?:>=|>|==|=|~=)?\s*(3\.\d+)', 1) else '' end), lambda x: x <> ''))), ',') as versions from documents where text is not null""")
def python_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The Python versions that a text notes, upper bounds left out."""
    return _docs(spark, sf).select("doc_id", F.array_join(lines.python_versions("text"), ",").alias("versions"))


@query(sql=r"""
 select instance_id, 'module m' || n || case when n % 2 = 0 then '/v' || n else '' end as head, case when n % 2 = 0 then 'v' || n else 'unknown' end as major, '1.' || n as go, cast(3 + 1 as int) as requires from (select distinct instance_id, length(instance_id) as n from materialized_items where instance_id is not null)""")
def go_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Module files made from the ids and read back."""
    n = F.length("instance_id").cast("string")
    module = F.concat(F.lit("m"), n, F.when(F.length("instance_id") % 2 == 0, F.concat(F.lit("/v"), n)).otherwise(""))
    made = F.concat(F.lit("// first\nmodule "), module, F.lit("\n\ngo 1."), n, F.lit("\nrequire (\n\ta v1 // indirect\n\tb v2\n\n\tc v3\n)\nrequire d v4\nreplace x => y\n"))
    return _items(spark, sf).select("instance_id", lines.go_module(made).alias("m")).select("instance_id", F.concat(F.lit("module "), F.col("m.module")).alias("head"), F.col("m.major").alias("major"), F.col("m.go").alias("go"), F.col("m.requires").alias("requires"))


@query(sql=r"""
 select instance_id, 'a-' || coalesce(repo, '') || '-' || '${none}' || '-' || coalesce(version, '') || '!' as out, 'x==1,y>=' || coalesce(regexp_replace(regexp_replace(regexp_replace(version, '#.*$', ''), '^\s+|\s+$', '', 'g'), '^$', ''), '') as needs
 from (select distinct instance_id, repo, version from materialized_items where instance_id is not null)""")
def interpolations(spark: SparkSession, sf: str) -> DataFrame:
    """Named values put into a text, and the lines of a requirements file."""
    known = F.map_from_arrays(F.array(F.lit("repo"), F.lit("version")), F.array(F.coalesce("repo", F.lit("")), F.coalesce("version", F.lit(""))))
    needs = lines.dependencies(F.concat(F.lit("# all\n  x==1  # pinned\n\ny>="), F.coalesce("version", F.lit("")), F.lit("\n")))
    return _items(spark, sf, "repo", "version").select("instance_id", lines.interpolated(F.lit("a-${repo}-${none}-${ version }!"), known).alias("out"), F.array_join(needs, ",").alias("needs"))


@query(sql=r"""
 select solver_id, regexp_replace(lower(trim(coalesce(model_name, ''), E' \t\n\r')), '_', '-', 'g') as plain, split_part(regexp_replace(lower(trim(coalesce(model_name, ''), E' \t\n\r')), '_', '-', 'g'), '/', -1) as last_part from (select distinct solver_id, model_name from solvers)""")
def model_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "solvers").select("solver_id", "model_name").distinct()
    return rows.select("solver_id", text.model_name("model_name").alias("plain"), F.element_at(F.split(text.model_name("model_name"), "/"), -1).alias("last_part"))


_NAME = r"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''), E' \t\n\r')), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(sql=rf"""
 select distinct instance_id, replace(trim(coalesce(repo, ''), E' \t\n\r'), '/', '__') || '-rg-' || left(trim(coalesce(commit_sha, ''), E' \t\n\r'), 12) as made_id, case when {_NAME.format(c='repo')} = '' then 'unnamed' when regexp_matches({_NAME.format(c='repo')}, '^[0-9]') then '_' || {_NAME.format(c='repo')} else {_NAME.format(c='repo')} end as module_name,
  case when regexp_replace(regexp_replace(coalesce(repo, ''), '[^A-Za-z0-9_:-]', '-', 'g'), '^-+|-+$', '', 'g') = '' then 'judge' else regexp_replace(regexp_replace(trim(coalesce(repo, ''), E' \t\n\r'), '[^A-Za-z0-9_:-]', '-', 'g'), '^-+|-+$', '', 'g') end || '-' || left(sha256(instance_id), 12) as artifact from materialized_items where instance_id is not null""")
def instance_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, module names and artifact names made of repository and commit."""
    return _items(spark, sf, "repo", "commit_sha").select(
        "instance_id", text.instance_id("repo", "commit_sha").alias("made_id"), text.safe_name("repo").alias("module_name"), text.artifact_name("repo", F.sha2("instance_id", 256)).alias("artifact")).distinct()


@query(needs=("v_attempts",), sql="""
 select attempt_id, case when cost_micros is null then '-' when cost_micros <= 0 then '$0.00' when cost_micros < 10000 then '$' || format('{:.4f}', ((cost_micros + 50) // 100) / 10000) else '$' || format('{:,.2f}', ((cost_micros + 5000) // 10000) / 100) end as cost,
  case when duration_ms is null then '-' when duration_ms >= 60000 then format('{:.1f}m', ((duration_ms + 3000) // 6000) / 10) when duration_ms >= 1000 then format('{:.1f}s', ((duration_ms + 50) // 100) / 10) else duration_ms || 'ms' end as duration from v_attempts""")
def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Costs and durations as they are shown."""
    rows = views.attempts(spark, sf, "cost_micros", "duration_ms")
    return rows.select("attempt_id", text.currency(F.col("cost_micros") / 1_000_000).alias("cost"), text.duration("duration_ms").alias("duration"))


@query(sql=r"""
 select instance_id, left(sha256('{"base":' || to_json(base_commit)::varchar || ',"repo":' || to_json(repo)::varchar || ',"version":' || to_json(version)::varchar || '}'), 16) as hash from (select distinct instance_id, coalesce(repo, '') as repo, coalesce(version, '') as version, coalesce(base_commit, '') as base_commit from materialized_items where instance_id is not null)""")
def feature_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of a JSON object with sorted keys, as sixteen digits."""
    j = lambda c: text.json_text(F.coalesce(c, F.lit("")))
    return _items(spark, sf, "repo", "version", "base_commit").select("instance_id", text.canonical_hash({"repo": j("repo"), "version": j("version"), "base": j("base_commit")}, 16).alias("hash"))


@query(needs=("v_runs",), sql=r"""
 , l as (select attempt_id, list_filter(list_transform(regexp_split_to_array(stderr_output, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') as f from v_runs where stderr_output is not null)
 select attempt_id, f[-1] as summary, regexp_matches(lower(array_to_string(f, ' ')), 'test timed out after|deadline exceeded|timed out after|connection timed out|read timed out') as timed_out from l where not list_has_any(list_transform(f, lambda x: contains(x, 'Test timed out after ') or contains(x, '>>>>> Patch Apply Failed:') or contains(x, 'failed to start podman system service') or contains(x, 'Failed to apply patch to container:') or x like '202% - INFO - %'), [true])""")
def log_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What a log ends with where it marks no failure."""
    marked = F.exists(lines.split("stderr_output"), lambda x: x.rlike(r"Test timed out after |>>>>> Patch Apply Failed:|failed to start podman system service|Failed to apply patch to container:|^\s*202.* - INFO - "))
    told = (lines.failure_summary("stderr_output").alias("summary"), verdicts.infra_timeout(F.regexp_replace("stderr_output", r"\s+", " ")).alias("timed_out"))
    return views.runs(spark, sf, F.col("stderr_output").isNotNull().alias("there"), marked.alias("marked"), *told).filter("there and not marked").select("attempt_id", "summary", "timed_out")


# --- references and contexts -------------------------------------------------------------

_ISSUES = r"regexp_extract_all(' ' || d.text, '(?i)[^A-Za-z0-9](?:#|gh-)(\d+)\b', 1)"


@query(sql=SQL["commit_refs"].replace(" select doc_id, array_to_string(", ", refs_ as (select doc_id, array_to_string(", 1) + r"""),
 each as (select r.doc_id, lower(trim(d.repo)) as repo, u.pos, string_split(r.issues, ',')[u.pos] as ref from refs_ r join documents d using (doc_id), lateral (select unnest(range(1, len(string_split(r.issues, ',')) + 1)) as pos) u where r.issues <> ''),
 cache as (select lower(trim(repo)) as repo, cast(doc_id % 400 as varchar) as ref, min(left(text, 40)) as title from documents where text is not null and repo is not null and doc_id % 3 <> 0 and trim(left(text, 40)) <> '' group by all),
 f as (select e.*, c.title from each e left join cache c using (repo, ref))
 select doc_id, string_agg(ref, ',' order by pos) as refs, arg_min(ref, pos) filter (title is not null) as ref, arg_min(title, pos) filter (title is not null) as title from f group by doc_id""")
def issue_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The issues a text names, looked up in a cache made of the documents; the first with a title speaks."""
    docs = _docs(spark, sf, "repo").withColumn("refs", text.issue_refs("text"))
    cache = _docs(spark, sf, "repo").filter("repo is not null and doc_id % 3 <> 0 and trim(left(text, 40)) <> ''").groupBy(
        F.lower(F.trim("repo")).alias("repo"), (F.col("doc_id") % 400).cast("string").alias("number")).agg(F.min(F.left("text", F.lit(40))).alias("title"))
    known = cache.select("*", F.lit("").alias("body"), F.lit("issue").alias("kind"), F.lit("ok").alias("status"))
    found = enrich.first_titled(enrich.looked_up(docs.filter(F.size("refs") > 0), known, "doc_id", "repo", "refs", "issue"), "doc_id")
    return found.select("doc_id", "refs", "ref", "title")


@query(sql=r"""
 with c as (select distinct instance_id, 0 as pos, nullif(trim(coalesce(version, '')), '') as ref, nullif(trim(coalesce(status, '')), '') as title, null as body from materialized_items where instance_id is not null union
  select distinct instance_id, 1, nullif(trim(coalesce(version, '')), ''), null, nullif(trim(coalesce(repo, '')), '') from materialized_items where instance_id is not null),
 k as (select *, coalesce(ref, title, body) as key from c where coalesce(ref, title, body) is not null)
 select instance_id, min(pos) as first_pos, arg_min(ref, pos) filter (ref is not null) as ref, arg_min(title, pos) filter (title is not null) as title, arg_min(body, pos) filter (body is not null) as body from k group by instance_id, key""")
def merged_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Two contexts of each item, merged where they name the same thing."""
    rows, none = _items(spark, sf, "version", "status", "repo"), F.lit(None).cast("string")
    one = rows.select("instance_id", F.lit(0).alias("pos"), F.col("version").alias("ref"), F.col("status").alias("title"), none.alias("body"), none.alias("url"))
    two = rows.select("instance_id", F.lit(1).alias("pos"), F.col("version").alias("ref"), none.alias("title"), F.col("repo").alias("body"), none.alias("url"))
    return enrich.merged_contexts(one.unionAll(two).distinct(), "instance_id").drop("url")


@query(sql=r"""
 with k as (select distinct split_part(repo, '/', 2) as name from documents where repo is not null)
 select distinct doc_id, name from (select doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_]+-[A-Za-z0-9]+\b')) as name from documents where text is not null) semi join k using (name)""")
def named_projects(spark: SparkSession, sf: str) -> DataFrame:
    """The projects whose name a text holds."""
    known = table(spark, sf, "documents").filter("repo is not null").select(F.split_part("repo", F.lit("/"), F.lit(2)).alias("name"))
    return enrich.named_in(_docs(spark, sf), "doc_id", "text", known, "name").distinct()


@query(sql=r"""
 with i as (select instance_id, arg_max(candidate_id, (ingested_at, candidate_id)) as candidate_id from materialized_items where instance_id is not null group by instance_id), d as (select instance_id, min(resolved) as decision from instance_results where instance_id is not null group by instance_id), h as (select instance_id, max(cluster_label) as hint from task_features group by instance_id)
 select instance_id, candidate_id, coalesce(nullif(decision, ''), 'none') as decision, coalesce(hint, 'none') as hint from i left join d using (instance_id) left join h using (instance_id)""")
def reviewed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with their decision and hint, where there are any."""
    rows = table(spark, sf, "materialized_items").filter("instance_id is not null").groupBy("instance_id").agg(F.max(F.struct("ingested_at", "candidate_id"))["candidate_id"].alias("candidate_id"))
    decisions = table(spark, sf, "instance_results").filter("instance_id is not null").groupBy("instance_id").agg(F.min("resolved").alias("decision"))
    hints = table(spark, sf, "task_features").groupBy("instance_id").agg(F.max("cluster_label").alias("hint"))
    none = F.lit("none")
    joined = rows.join(decisions, "instance_id", "left").join(hints, "instance_id", "left")
    return joined.select("instance_id", "candidate_id", F.coalesce(F.nullif("decision", F.lit("")), none).alias("decision"), F.coalesce("hint", none).alias("hint"))


@query(sql=r"""
 with a as (select instance_id, version from (select distinct instance_id, version, row_number() over (partition by instance_id order by coalesce(version, '')) as rn from materialized_items where instance_id is not null) where rn = 1)
 select instance_id, coalesce(version, '') as version from a semi join (select distinct instance_id from instance_results) using (instance_id) anti join (select distinct instance_id from instance_results where harness_outcome = 'error') using (instance_id)""")
def planned_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a result and without an error, each once."""
    rows = _items(spark, sf, "version").withColumn("at", F.coalesce("version", F.lit("")))
    results = table(spark, sf, "instance_results").filter("instance_id is not null")
    return planning.filtered_ids(rows, "instance_id", "at", results, results.filter("harness_outcome = 'error'")).select("instance_id", F.coalesce("version", F.lit("")).alias("version"))


# --- patches -----------------------------------------------------------------------------

_PATHS = r"list_filter(list_concat(regexp_extract_all({c}, '(?m)^diff --git \"?a/.+?\"? \"?b/(.+?)\"?$', 1), regexp_extract_all({c}, '(?m)^\+\+\+ b/(.+)$', 1)), lambda p: not p like '%.rej')"


@query(sql=rf"""
 with p as (select instance_id, {_PATHS.format(c='test_patch')} as l from (select distinct instance_id, test_patch from materialized_items where test_patch is not null and instance_id is not null)),
 q as (select instance_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from p),
 r as (select *, list_filter(l, lambda x: regexp_matches(lower(x), '^tests/') and regexp_matches(lower(x), 'conftest\.py$|pytest\.ini$|tox\.ini$|fixtures|testdata$')) as s from q),
 t as (select *, list_filter(l, lambda x: lower(x) like '%.py' and (regexp_matches(lower(x), '^(?:tests?|spec|testsuites)/') or regexp_matches(split_part(lower(x), '/', -1), '^test_|_test\.py$|_test_|spec')) and not list_contains(s, x)) as f from r)
 select instance_id, array_to_string(case when len(f) > 0 then f when len(s) > 0 then ['tests'] else [] end, ',') as inputs, array_to_string(l, ',') as immutable from t""")
def targeted_tests(spark: SparkSession, sf: str) -> DataFrame:
    """What to run for a test patch, and the paths it withholds."""
    rows = _items(spark, sf, "test_patch").filter("test_patch is not null")
    none = F.lit(None).cast("array<string>")
    return rows.select("instance_id", F.array_join(patch.targeted_tests("test_patch"), ",").alias("inputs"), F.array_join(patch.immutable_paths(none, "test_patch"), ",").alias("immutable"))


@query(sql=r"""
 with c as (select instance_id, list_transform(list_filter(string_split(patch, chr(10)), lambda x: regexp_matches(x, '^[+-].') and not x like '+++%' and not x like '---%'), lambda x: trim(x[2:])) as l from (select distinct instance_id, patch from materialized_items where patch is not null and instance_id is not null))
 select instance_id, len(l) > 0 and len(l) <= 80 and len(list_filter(l, lambda x: regexp_matches(x, '[A-Za-z0-9_]{3,}') or regexp_matches(x, '\b(?:def|class|return|assert|if|for|while|with|except|raise|import|from) '))) = 0 as formatting from c""")
def formatting_patches(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf, "patch").filter("patch is not null").select("instance_id", patch.formatting_only("patch").alias("formatting"))


@query(sql=r"""
 select distinct instance_id, 'gold' as model_name_or_path, sha256(trim(coalesce(patch, ''), E' \t\n\r')) as patch_hash from materialized_items where coalesce(trim(instance_id), '') <> ''""")
def gold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The reference patch of every item as a prediction, by its hash."""
    rows = records_gold(_items(spark, sf, "patch"))
    return rows.select("instance_id", "model_name_or_path", F.sha2("model_patch", 256).alias("patch_hash"))


def records_gold(items: DataFrame) -> DataFrame:
    return items.filter("coalesce(trim(instance_id), '') <> ''").select("instance_id", F.lit("gold").alias("model_name_or_path"), coerce.text("patch").alias("model_patch"))


@query(sql=r"""
 select instance_id, length(trim(patch, E' \t\n\r')) + 1 as n_chars, true as same from (select distinct instance_id, patch from materialized_items where patch like 'diff --git%' and not contains(patch, '```') and instance_id is not null)""")
def extracted_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches put into a fence and into JSON lines, and read out again."""
    rows = _items(spark, sf, "patch").filter("patch like 'diff --git%' and not contains(patch, '```')")
    fenced = F.concat(F.lit("Here it is:\n```diff\n"), F.col("patch"), F.lit("\n```\nDone."))
    as_json = F.concat(F.lit('{"type":"start"}\n'), F.to_json(F.struct(F.lit("message").alias("type"), fenced.alias("text"))))
    a, b = patch.patch_of_output(fenced, F.array().cast("array<string>")), patch.patch_of_output(as_json, F.array(usage.last_message(as_json)))
    return rows.select("instance_id", F.length(a).alias("n_chars"), (a == b).alias("same"))


@query(sql=r"""
 select instance_id, 'src/a.py,src/' || coalesce(version, 'x') || '.py,c.txt' as paths, cast(length('one') + length(coalesce(repo, '')) + 0 as int) as n_chars from (select distinct instance_id, repo, version from materialized_items where instance_id is not null)""")
def edit_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Edit plans written as JSON and read back."""
    files = F.array(F.struct(F.lit("src/a.py").alias("path"), F.lit("one").alias("content")), F.struct(F.concat(F.lit("src/"), F.coalesce("version", F.lit("x")), F.lit(".py")).alias("path"), F.coalesce("repo", F.lit("")).alias("content")))
    plan = F.to_json(F.struct(files.alias("files"), F.array(F.struct(F.lit("c.txt").alias("path"))).alias("edits")))
    read = _items(spark, sf, "repo", "version").select("instance_id", patch.edits(F.try_parse_json(plan)).alias("e"))
    return read.select("instance_id", F.array_join(F.transform("e", lambda x: x["path"]), ",").alias("paths"), F.aggregate("e", F.lit(0), lambda n, x: n + F.length(x["content"])).alias("n_chars"))


@query(sql=rf"""
 select instance_id, len(l) as n_paths, len(list_filter(l, lambda p: p like '/%' or regexp_matches(p, '(^|/)\.\.(/|$)'))) as n_unsafe from (select instance_id, list_distinct({_PATHS.format(c="p")}) as l from (select distinct instance_id, case when length(instance_id) % 2 = 0 then patch else replace(patch, ' b/', ' b/../') end as p from materialized_items where patch is not null and instance_id is not null))""")
def unsafe_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that leave the tree, in patches half of which were made to."""
    p = F.when(F.length("instance_id") % 2 == 0, F.col("patch")).otherwise(F.replace("patch", F.lit(" b/"), F.lit(" b/../")))
    rows = _items(spark, sf, "patch").filter("patch is not null").withColumn("p", p)
    return rows.select("instance_id", F.size(patch.paths("p")).alias("n_paths"), F.size(patch.unsafe_paths("p")).alias("n_unsafe"))


@query(sql=r"""
 select instance_id, n_versions, label, left(sha256(label), 16) as signature from (select instance_id, len(v) as n_versions, coalesce(nullif(v[1], ''), 'unknown') || '__' || array_to_string(v, '+') as label from (select instance_id, list_sort(list_distinct(list(coalesce(version, '')))) as v from materialized_items where instance_id is not null group by instance_id))""")
def environment_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """A label and a hash of the sorted versions an item is seen with (deliveries of one item, so a few)."""
    v = F.array_sort(F.collect_set(F.coalesce("version", F.lit(""))))
    rows = table(spark, sf, "materialized_items").filter("instance_id is not null").groupBy("instance_id").agg(v.alias("v"))
    label = F.concat(F.coalesce(F.nullif(F.element_at("v", 1), F.lit("")), F.lit("unknown")), F.lit("__"), F.array_join("v", "+"))
    return rows.select("instance_id", F.size("v").alias("n_versions"), label.alias("label"), F.left(F.sha2(label, 256), F.lit(16)).alias("signature"))


# --- reports -----------------------------------------------------------------------------


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return views.verdicts(spark, sf).select("solver_id", "instance_id", F.when(F.col("resolved"), "pass").when(F.lower("harness_outcome").contains("error"), "skip").otherwise("fail").alias("outcome"), F.pmod(F.xxhash64("instance_id"), F.lit(64)).alias("shard"))


_OUTCOMES = "(select solver_id, instance_id, case when resolved then 'pass' when contains(lower(coalesce(harness_outcome, '')), 'error') then 'skip' else 'fail' end as outcome from v_verdicts)"


@query(needs=("v_verdicts",), sql=f"select solver_id, 'pkg::' || instance_id as test_id, outcome from {_OUTCOMES}")
def go_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as event lines of a Go test run, twice, and parsed back."""
    rows = _outcomes(spark, sf)
    event = lambda a: F.to_json(F.struct(a.alias("Action"), F.lit("pkg").alias("Package"), F.col("instance_id").alias("Test")))
    one = F.concat_ws("\n", event(F.lit("run")), F.lit("no json"), event(F.lit("fail")), event(F.col("outcome")))
    report = rows.groupBy("solver_id", "shard").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("report"))  # one report a solver and shard
    return reports.go_test(report.select("solver_id", "shard", "report"), ["solver_id", "shard"], "report").select("solver_id", "test_id", "outcome")


@query(needs=("v_verdicts",), sql=f"select solver_id, 'crate::mod::' || instance_id as test_id, outcome from {_OUTCOMES}")
def cargo_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as a Cargo test run and parsed back."""
    word = F.when(F.col("outcome") == "pass", "ok").when(F.col("outcome") == "skip", "ignored").otherwise("FAILED")
    line = F.concat(F.lit("test mod::"), F.col("instance_id"), F.lit(" ... "), word)
    report = _outcomes(spark, sf).groupBy("solver_id", "shard").agg(F.concat(F.lit("     Running unittests src/lib.rs (target/debug/deps/crate-0123456789abcdef)\nrunning n tests\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\ntest result: ok")).alias("report"))
    return reports.parsed(report, "solver_id", "report", "cargo")


@query(needs=("v_verdicts",), sql=f"select solver_id, 'Suite case::' || instance_id as test_id, outcome from {_OUTCOMES}")
def junit_js_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as a JavaScript runner's JUnit report inside a payload, and parsed back."""
    mark = F.when(F.col("outcome") == "pass", "").when(F.col("outcome") == "skip", "<xpass/>").otherwise("<failure/>")
    case = F.concat(F.lit('<testcase classname="Suite case" name="'), F.col("instance_id"), F.lit('">'), mark, F.lit("</testcase>"))
    report = _outcomes(spark, sf).groupBy("solver_id", "shard").agg(F.concat(F.lit("<testsuites><testsuite>"), F.array_join(F.array_sort(F.collect_list(case)), ""), F.lit("</testsuite></testsuites>")).alias("report"))
    inside = report.select("solver_id", reports.payload(F.try_parse_json(F.to_json(F.struct(F.col("report").alias("junit_xml"))))).alias("report"))
    return reports.parsed(inside, "solver_id", "report", "junit-js")


@query(sql=r"""
 select repo, sum(n) as n_nodes, sum(f) as n_files from (select distinct repo, path, 2 as n, 1 as f from file_roles where path is not null and repo is not null and path not like '%::%' and trim(path) = path and path not like '=%' and path not like 'ERROR:%' and path not like 'no tests%' and not regexp_matches(path, '\s')) group by repo""")
def collected_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Paths written as a collection's output and read back as nodes and files."""
    rows = table(spark, sf, "file_roles").filter(r"path is not null and repo is not null and path not like '%::%' and trim(path) = path and path not like '=%' and path not like 'ERROR:%' and path not like 'no tests%' and not path rlike '\\s'").select("repo", "path").distinct()
    output = F.concat(F.lit("===== test session =====\n"), F.col("path"), F.lit("::test_a\n\n"), F.col("path"), F.lit("::C::test_b\n"), F.col("path"), F.lit("::test_a\nno tests collected in x::y"))
    read = rows.select("repo", lines.test_nodes(output).alias("nodes")).select("repo", F.size(lines.tidy_ids("nodes")).alias("n"), F.size(lines.node_files(F.col("nodes"))).alias("f"))
    return read.groupBy("repo").agg(F.sum("n").alias("n_nodes"), F.sum("f").alias("n_files"))


@query
def patch_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each item's patch and test patch by role, sorted, the two united."""
    rows = _items(spark, sf, "patch", "test_patch")
    one = lambda c: patch.roles(c)
    both = text.united(one("patch"), one("test_patch"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "|"))), ";")
    return rows.select("instance_id", told.alias("roles"))

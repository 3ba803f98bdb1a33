"""Every operator bound to the tables of a data folder: name to (spark, folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I  # noqa: E741
from ..operators import annotate as A
from ..operators import audit as U
from ..operators import citations as C
from ..operators import country as N
from ..operators import develop as D
from ..operators import master as M
from ..operators import network as K
from ..operators import papers as B
from ..operators import prepare as P
from ..operators import profiles as R
from ..operators import quality as Q
from ..operators import semantic as S
from ..operators import snapshot as X
from ..operators import vectors as V
from ..functions.windows import year_bounds
from ..sources import adapters as T
from ..sources.adapters import W
from ..sources.files import PREDICATION_COLUMNS, good_lines, line_account, read_raw_csv, read_snapshot, read_years, write_table
from ..sources.shared import shared_path, written
from ..sources.tables import publish, read_published, read_range, write_shards, write_years

#: The last year of the citation counts, the years and predicates that the sample leaves out.
CUTOFF = 2000
BAD_YEARS, BAD_PREDICATES = ("1995",), ("NO",)
LONG = {"s": "subject_cui_primary", "p": "PREDICATE", "o": "object_cui_primary"}


#: Queries that read the annotation once; the others have it written to the shared folder.
ONCE = {"edge_annotation", "edge_transition", "paper_annotation_metrics", "paper_adoption_metrics", "transition_summary", "adoption_summary", "adoption_decomposition", "decomposition_summary", "pattern_summary", "annotation_flag_report", "uniqueness_report", "prior_relation_candidates", "new_relation_proximity", "new_relation_summary"}


#: Tables that queries read several times, and so have written to the shared folder.
_YEARS, _PROFILES, _MASTER, _LINKS = ("profiled_once",), ("profiled", "profiled_once"), ("works_of_papers", "paper_metrics", "adoption"), ("links",)
SHARED = {
    **dict.fromkeys(("yearly_profile", "predicate_year_profile"), _YEARS), **dict.fromkeys(("overall_profile", "retention_by_year", "retention_by_predicate"), _PROFILES), "distinct_since": ("prepared",),
    **dict.fromkeys(("paper_master", "master_by_year", "missingness"), _MASTER), **dict.fromkeys(("master_exclusions", "sample_flow"), ("cohort", "works_of_papers", "focal_papers")), "shared_metric_conflicts": ("paper_metrics", "knowledge", "adoption", "development"),
    **dict.fromkeys(("audit_accounting", "audit_year_difference", "inspection_work_details"), _LINKS),
    **dict.fromkeys(("country_network", "country_network_summary", "country_network_coverage"), ("paper_country",)),
    "network_checks": ("edges", "adoption", "profile"), "paper_network_nodes": ("edges",), "agreement_summary": ("matched",), "agreement_by_year": ("matched",), "spearman": ("matched",), **dict.fromkeys(("new_relation_proximity", "new_relation_summary"), ("triples", "relations", "candidates", "names")), "vector_store": ("labels",), "decomposition_summary": ("decomposed",), "pattern_summary": ("paper_metrics",), "score_profile": ("proximity",), "proximity_summary": ("proximity",), "proximity_checks": ("proximity",), "prepare_diagnostics": ("raw",),
}


class Tables:
    """The domain tables of a folder, each built once when it is first asked for; the ``shared`` ones are written."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False, shared: tuple[str, ...] = ()):
        self.spark, self.dir, self.once, self.shared, self._made = spark, sf_dir, once, shared, {}

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            made = getattr(self, "_" + name)()
            self._made[name] = written(made) if name in self.shared else made
        return self._made[name]

    def _raw(self):
        return T.predications(self.spark, self.dir)

    def _citations(self):
        return T.citations(self.spark, self.dir)

    def _triples(self):
        return T.triples(self.spark, self.dir)

    def _prepared(self):
        return P.prepare_triples(self.get("raw"), self.get("citations"))

    def _keyed(self):
        return P.with_keys(self.get("raw"), self.get("citations")).filter(F.col("passes_novelty") & ~F.col("missing_key"))

    def _profiled(self):
        return self.get("keyed").select(*P.PROFILED, "source_order")

    def _profiled_once(self):
        return P.first_triples(self.get("profiled"))

    def _bounds(self):
        return T.year_bounds(self.spark, self.dir)

    def _rows(self):
        rows = A.annotated_rows(self.get("triples"), W)
        return rows if self.once else written(rows)

    def _annotated(self):
        return A.annotation_of(self.get("rows"), W, self.get("bounds"))

    def _transitions(self):
        return A.transition_of(self.get("rows"), W, self.get("bounds"))

    def _wide(self):
        wide = written(self.get("prepared").withColumnsRenamed({v: k for k, v in LONG.items()}).withColumn("PYEAR", F.col("PYEAR").cast("int")))
        return A.annotated_rows(wide, W), year_bounds(wide, "PYEAR")

    def years(self, name: str, first: int = 0, last: int = 0):
        """All years of the papers as a column; ``first`` and ``last`` move the ends."""
        a, b = self.get("bounds")
        return self.spark.range((a or 0) + first, (b if b is not None else -1) + last + 1).select(F.col("id").cast("int").alias(name))

    def _paper_metrics(self):
        return B.paper_annotation_metrics(self.get("annotated"))

    def _adoption(self):
        return B.paper_adoption_metrics(self.get("transitions"))

    def _knowledge(self):
        return B.paper_new_knowledge(self.get("annotated"))

    def _decomposed(self):
        return B.adoption_decomposition(self.get("adoption"))

    def _node_dev(self):
        return D.new_node_development(self.get("annotated"), W, self.get("bounds")[1])

    def _pair_dev(self):
        return D.new_combination_development(self.get("annotated"), W, self.get("bounds")[1])

    def _development(self):
        return D.paper_development_metrics(self.get("transitions"), self.get("node_dev"), self.get("pair_dev"))

    def _edges(self):
        return K.paper_network_edges(self.get("annotated"), W, self.get("bounds")[1])

    def _nodes(self):
        first, last = self.get("bounds")
        return K.paper_network_nodes(self.get("annotated"), self.get("adoption"), self.get("edges"), W, (None if first is None else first + W, last))

    def _profile(self):
        return K.paper_network_profile(self.get("annotated"), W, self.get("bounds")[1])

    def _paper_country(self):
        return T.paper_countries(self.spark, self.dir)

    def _network(self):
        return N.country_network(self.get("transitions"), self.get("annotated"), self.get("paper_country"), W)

    def _authorship(self):
        return N.authorship_institution(T.authorships(self.spark, self.dir), T.institutions(self.spark, self.dir), T.work_ids(self.spark, self.dir))

    def _counted(self):
        return N.pmid_country(self.get("authorship"))

    def _lists(self):
        return N.pmid_country_lists(self.get("counted"))

    def _years(self):
        rows = T.work_years(self.spark, self.dir).select(I.work_strict(F.col("work_id")).alias("work_id"), I.year_strict(F.col("publication_year")).alias("year"))
        return rows.filter("work_id is not null and year is not null").groupBy("work_id").agg(F.min("year").alias("year"))

    def _windows(self):
        return C.citation_windows(T.references(self.spark, self.dir), self.get("years"), CUTOFF)

    def _other(self):
        return T.source_papers(self.spark, self.dir).select(F.col("paperid").alias("work_id"), I.year_strict(F.col("year")).alias("other_year"), *[F.col(f"C{k}").alias(f"other_C{k}") for k in C.WINDOWS])

    def _matched(self):
        return C.citation_match(self.get("windows"), self.get("other"))

    def _concepts(self):
        return R.concept_profile(P.first_triples(self.get("keyed").select(*P.PROFILED, "SUBJECT_SEMTYPE", "OBJECT_SEMTYPE", "source_order")))

    def _labels(self):
        return S.concept_text(self.get("concepts"))

    def _vectors(self):
        return T.concept_vectors(self.spark, self.dir)

    def _names(self):
        return S.concept_labels(P.first_triples(self.get("keyed").select(*P.TRIPLE_KEY, "subject_name_primary", "object_name_primary", "source_order")))

    def _relations(self):
        return self.get("annotated").filter(F.col("edge_annotation") == A.NEW[2]).select("PMID", "PYEAR", "s", "p", "o", "edge_annotation")

    def _candidates(self):
        return S.prior_relation_candidates(self.get("triples"), self.get("relations"), W)

    def _scored_relations(self):
        return S.new_relation_proximity(self.get("triples"), self.get("relations"), self.get("names"), W, candidates=self.get("candidates"))

    def _proximity(self):
        return S.new_combination_proximity(self.get("annotated"), self.get("vectors"))

    def _cohort(self):
        return self.get("triples").select("PMID", "PYEAR").distinct()

    def _ids(self):
        return T.work_ids(self.spark, self.dir)

    def _links(self):
        return U.audit_links(self.get("cohort"), self.get("citations"), self.get("ids"), T.work_years(self.spark, self.dir))

    def _works_of_papers(self):
        return self.get("links").select("pmid", "work_id", "n_pmids_for_work", "openalex_year")

    def _matches(self):
        return U.paper_matches(self.get("works_of_papers"))

    def _focal_papers(self):
        return A.focal_rows(self.get("triples"), W, self.get("bounds")).select("PMID", "PYEAR").distinct()

    def _papers(self):
        return U.audit_papers(self.get("links"))

    def _audit3(self):
        return U.audit3_rows(self.get("cohort"), self.get("citations"), self.get("ids"), T.work_years(self.spark, self.dir), self.get("source"))

    def _source(self):
        return T.source_papers(self.spark, self.dir)

    def _modules(self):
        return {"annotation": self.get("paper_metrics"), "pattern": B.paper_pattern(self.get("paper_metrics")), "new_knowledge": self.get("knowledge"), "adoption": self.get("adoption"), "development": self.get("development"), "decomposition": self.get("decomposed")}

    def _master(self):
        return M.paper_master(self.get("modules"), self.get("matches"), self.get("works_of_papers"), self.get("source"), 1999, CUTOFF)

    def _works(self):
        return T.snapshot_works(self.spark, self.dir)

    def _entities(self):
        return T.snapshot_entities(self.spark, self.dir)

    def _focal_years(self):
        return self.get("transitions").select(F.col("PYEAR").alias("focal_year")).distinct()


def _scalars(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    """Scalar functions over columns of the tables."""
    ids, raw, cit = (lambda: t.get("ids")), (lambda: t.get("raw")), (lambda: t.get("citations"))
    inst = lambda: T.institutions(t.spark, t.dir)
    return {
        "primary_component": lambda: raw().select("PREDICATION_ID", I.primary_component(F.col("SUBJECT_CUI")).alias("subject_cui_primary"), I.component_count(F.col("SUBJECT_CUI")).alias("n_components")),
        "novelty_filter": lambda: raw().select("PREDICATION_ID", I.passes_novelty(F.col("SUBJECT_NOVELTY"), F.col("OBJECT_NOVELTY")).alias("passes")),
        "normalize_pmid_strict": lambda: ids().select("work_id", F.col("pmid").alias("raw_pmid"), I.pmid_strict(F.col("pmid")).alias("pmid")),
        "normalize_pmid_loose": lambda: ids().select("work_id", F.col("pmid").alias("raw_pmid"), I.pmid_loose(F.col("pmid")).alias("pmid")),
        "normalize_work_id": lambda: ids().select(F.col("work_id").alias("raw_work_id"), I.work_strict(F.col("work_id")).alias("strict"), I.work_loose(F.col("work_id")).alias("loose")),
        "normalize_doi": lambda: ids().select("work_id", F.col("doi").alias("raw_doi"), I.doi_norm(F.col("doi")).alias("doi")),
        "strict_year": lambda: T.work_years(t.spark, t.dir).select("work_id", "publication_year", I.year_strict(F.col("publication_year")).alias("year")),
        "country_code_norm": lambda: inst().select("institution_id", "version", I.country_code(F.col("country_code"), F.col("geo_code"), F.col("country_name")).alias("code")),
        "predicate_phrase": lambda: raw().select(F.concat_ws("_", "PREDICATE", F.col("SUBJECT_SEMTYPE")).alias("predicate")).distinct().select("predicate", I.predicate_phrase(F.col("predicate")).alias("phrase")),
        "date_year_parts": lambda: cit().select("PMID", I.date_year(F.col("DP")).alias("dp_year"), I.date_year(F.col("EDAT")).alias("edat_year")),
    }


def _plans(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    g = t.get
    key = ["PMID", "s", "p", "o"]
    stored = ["PMID", "n_triples", "n_new_triples", "share_new_triples", "share_new_node"]
    return _scalars(t) | {
        "split_by_year_counts": lambda: P.split_by_year_counts(g("prepared")),
        "shard_manifest": lambda: P.shard_manifest(_numeric_references(t), "work", 500),
        "write_shards": lambda: write_shards(_numeric_references(t), shared_path(t.spark, "shards"), ["work"], 500),
        "read_ordered_range": lambda: _range_of(t, _numeric_references(t), "work", 500, 1000, 2000),
        "write_years": lambda: write_years(g("prepared"), shared_path(t.spark, "years"), g("bounds")),
        "publish_table": lambda: _published(t, g("paper_metrics"), {"no triples": F.col("n_triples") <= 0, "more new than all": F.col("n_new_triples") > F.col("n_triples")}),
        "read_years": lambda: P.split_by_year_counts(_by_year(t, g("prepared"), 1997, 1999)),
        "read_snapshot": lambda: X.flatten_references(_from_json(t, g("works"))),
        "edge_annotation_prepared": lambda: A.annotation_of(g("wide")[0], W, g("wide")[1]),
        "edge_transition_prepared": lambda: A.transition_of(g("wide")[0], W, g("wide")[1]),
        "publish_gate": lambda: Q.rule_report(g("paper_metrics"), {"no triples": F.col("n_triples") <= 0, "more new than all": F.col("n_new_triples") > F.col("n_triples")}).withColumn("may_publish", F.col("n_violations") == 0),
        "filter_linked_rows": lambda: P.filter_linked_rows(g("ids").withColumn("pmid", F.when(F.col("pmid") == "none", " ").otherwise(F.col("pmid")))),
        "relation_text": lambda: S.relation_text(g("triples"), g("labels")),
        "explode_country_list": lambda: N.explode_country_list(g("lists")),
        "raw_line_account": lambda: line_account(_raw_lines(t, g("raw")), "bad_line").drop("example"),
        "raw_good_lines": lambda: good_lines(_raw_lines(t, g("raw")), "bad_line").select("PREDICATION_ID", "PMID", "PREDICATE", "SUBJECT_CUI", "OBJECT_CUI"),
        "prepare_triples": lambda: g("prepared"),
        "dedup_triples": lambda: g("prepared").select("PREDICATION_ID", *P.TRIPLE_KEY),
        "prepare_diagnostics": lambda: P.prepare_diagnostics(g("raw"), g("citations")),
        "analysis_sample": lambda: P.analysis_sample(g("prepared"), BAD_YEARS, BAD_PREDICATES),
        "analysis_sample_counts": lambda: P.analysis_sample_counts(g("prepared"), BAD_YEARS, BAD_PREDICATES),
        "duplicate_metrics": lambda: R.duplicate_metrics(g("keyed"), R.PRIMARY_KEY),
        "group_size_distribution": lambda: R.group_size_distribution(g("keyed"), R.PRIMARY_KEY),
        "collision_summary": lambda: R.collision_summary(g("keyed")),
        "collision_examples": lambda: R.collision_examples(g("keyed")),
        "duplicate_scope_summary": lambda: R.duplicate_scope_summary(g("keyed")),
        "duplicate_overall_rollup": lambda: R.duplicate_overall_rollup(R.duplicate_scope_summary(g("keyed"))),
        "uniqueness_report": lambda: Q.uniqueness_report({"raw rows by paper and primary triple": (g("keyed"), R.PRIMARY_KEY), "prepared": (g("prepared"), list(P.TRIPLE_KEY)), "annotation": (g("annotated"), key)}),
        "conflict_report": lambda: Q.conflict_report(g("raw"), {"concept with several types": (["OBJECT_CUI"], ["OBJECT_SEMTYPE"]), "paper with several sentences": (["PMID"], ["SENTENCE_ID"]), "statement with several papers": (["PREDICATION_ID"], ["PMID"])}),
        "rank_first_lookup": lambda: N.rank_first_lookup(T.institutions(t.spark, t.dir)),
        "agreed_year": lambda: U.agreed_year(g("citations")),
        "same_pair_other_predicate": lambda: A.same_pair_other_predicate(g("annotated")),
        "endpoint_or_join": lambda: D.endpoint_or_join(g("annotated"), W, g("bounds")[1]),
        "prior_relation_candidates": lambda: S.prior_relation_candidates(g("triples"), g("annotated"), W),
        "score_profile": lambda: S.score_profile(g("proximity").withColumn("kind", F.substring("s", 1, 1)), "proximity", ["PYEAR", "kind"]),
        "agreement_summary": lambda: C.agreement_summary(g("matched")),
        "agreement_by_year": lambda: C.agreement_by_year(g("matched")),
        "spearman": lambda: C.spearman(g("matched")),
        "missingness": lambda: M.missingness(g("master")),
        "prior_overlap": lambda: R.prior_overlap(g("prepared")),
        "prior_jaccard": lambda: R.prior_jaccard(g("prepared")),
        "prior_jaccard_by_bitmaps": lambda: R.prior_jaccard_by_bitmaps(g("prepared")),
        "distinct_since": lambda: R.distinct_since(g("prepared")),
        "prior_nodes": lambda: A.prior_nodes(g("triples"), W, g("bounds")),
        "long_concepts": lambda: R.long_concepts(g("prepared")).select("PMID", "PYEAR", "PREDICATE", "role", "concept", "name", "semtype", "neighbour"),
        "set_equality_report": lambda: Q.set_equality_report(g("annotated").select(*key, "edge_annotation"), g("transitions").select(*key, "edge_annotation"), "annotation and transition"),
        "bag_equality_report": lambda: Q.bag_equality_report(g("annotated").filter((F.col("edge_annotation") == "New_Node") & (F.col("PYEAR") <= 1999)).select(*key), g("node_dev").select(*key), "new nodes and their development"),
        "yearly_profile": lambda: R.yearly_profile(g("profiled_once")),
        "predicate_year_profile": lambda: R.predicate_year_profile(g("profiled_once")),
        "concept_profile": lambda: g("concepts"),
        "edge_annotation": lambda: g("annotated"),
        "annotation_summary": lambda: A.annotation_summary(g("triples"), W, g("bounds"), g("annotated")),
        "self_loop_summary": lambda: A.self_loop_summary(g("triples"), W, g("bounds")),
        "annotation_checks": lambda: A.annotation_checks(A.annotation_summary(g("triples"), W, g("bounds"), g("annotated")), W),
        "edge_transition": lambda: g("transitions"),
        "transition_summary": lambda: A.transition_summary(g("transitions")),
        "paper_annotation_metrics": lambda: g("paper_metrics"),
        "paper_pattern": lambda: B.paper_pattern(g("paper_metrics")),
        "pattern_summary": lambda: B.pattern_summary(g("paper_metrics")),
        "paper_new_knowledge": lambda: g("knowledge"),
        "year_new_knowledge": lambda: B.year_new_knowledge(g("annotated"), t.years("PYEAR")),
        "paper_adoption_metrics": lambda: g("adoption"),
        "adoption_summary": lambda: B.adoption_summary(g("adoption")),
        "adoption_decomposition": lambda: g("decomposed"),
        "decomposition_summary": lambda: B.decomposition_summary(g("decomposed")),
        "new_node_development": lambda: g("node_dev").drop(*A.FLAGS),
        "new_combination_development": lambda: g("pair_dev").drop(*A.FLAGS),
        "development_summary_node": lambda: D.development_summary(g("node_dev"), D.NODE_PREFIXES),
        "development_summary_pair": lambda: D.development_summary(g("pair_dev"), D.PAIR_PREFIXES),
        "paper_development_metrics": lambda: g("development"),
        "development_metrics_summary": lambda: D.development_metrics_summary(g("development")),
        "paper_network_edges": lambda: g("edges"),
        "paper_network_trace": lambda: K.paper_network_trace(g("annotated"), W, g("bounds")[1]),
        "paper_network_nodes": lambda: g("nodes"),
        "paper_network_profile": lambda: g("profile"),
        "paper_network_summary": lambda: K.paper_network_summary(g("edges"), t.years("focal_year")),
        "country_network": lambda: g("network"),
        "country_network_summary": lambda: N.country_network_summary(g("network")),
        "country_network_coverage": lambda: N.country_network_coverage(g("transitions"), g("annotated"), g("paper_country"), g("network"), W),
        "country_names": lambda: N.country_names(g("paper_country")),
        "country_network_by_key": lambda: N.country_network_by_key(g("transitions"), g("annotated"), g("paper_country"), W),
        "parallel_by_year_category": lambda: K.parallel_by_year_category(g("annotated")),
        "parallel_by_year": lambda: K.parallel_by_year(g("annotated")),
        "parallel_top_triples": lambda: K.parallel_top_triples(g("annotated")),
        "concept_text": lambda: g("labels"),
        "concept_text_summary": lambda: S.concept_text_summary(g("labels")),
        "embedding_norms": lambda: S.embedding_norms(S.embed(g("labels"), text_col="label")),
        "vector_store": lambda: _stored_vectors(t, g("labels")),
        "new_combination_proximity": lambda: g("proximity"),
        "proximity_summary": lambda: S.proximity_summary(g("proximity")),
        "proximity_checks": lambda: S.proximity_checks(S.proximity_summary(g("proximity"))),
        "new_relation_proximity": lambda: g("scored_relations"),
        "new_relation_summary": lambda: S.new_relation_summary(g("scored_relations"), g("candidates"), g("triples"), A.focal_rows(g("triples"), W, g("bounds")), W),
        "flatten_authorships": lambda: X.flatten_authorships(g("works")),
        "flatten_references": lambda: X.flatten_references(g("works")),
        "flatten_locations": lambda: X.flatten_locations(g("works")),
        "flatten_work_terms": lambda: X.flatten_work_terms(g("works")),
        "flatten_works": lambda: X.flatten_works(g("works")),
        "flatten_publication_years": lambda: X.flatten_publication_years(g("works")),
        **{f"flatten_work_{c}": lambda c=c: X.flatten_record(g("works"), c) for c in ("ids", "open_access", "biblio")},
        "flatten_entities": lambda: X.flatten_entities(g("entities")),
        "flatten_entity_geo": lambda: X.flatten_entity_geo(g("entities")),
        **{f"flatten_entity_{c}": lambda c=c: X.flatten_entity_links(g("entities"), c) for c in ("associated", "ancestors", "related")},
        "flatten_entity_counts": lambda: X.flatten_entity_counts(g("entities")),
        "flatten_entity_ids": lambda: X.flatten_entity_ids(g("entities")),
        "authorship_institution": lambda: g("authorship"),
        "authorship_coverage": lambda: N.authorship_coverage(g("authorship")),
        "pmid_country": lambda: g("counted"),
        "pmid_country_lists": lambda: g("lists"),
        "first_last_authors": lambda: N.first_last_authors(g("authorship")),
        "attach_country_lists": lambda: N.attach_country_lists(g("transitions").select("PMID", "PYEAR", "s", "p", "o"), g("lists")),
        "country_match_summary": lambda: N.country_match_summary(N.attach_country_lists(g("transitions").select("PMID", "PYEAR", "s", "p", "o"), g("lists"))),
        "citation_windows": lambda: g("windows"),
        "citation_windows_pmid": lambda: C.with_pmids(g("windows"), g("ids")),
        "citation_edge_accounting": lambda: C.citation_edge_accounting(T.references(t.spark, t.dir), g("years"), CUTOFF),
        "citation_match": lambda: g("matched"),
        "match_coverage": lambda: C.match_coverage(g("windows"), g("other")),
        "largest_differences": lambda: C.largest_differences(g("matched")),
        "linked_papers": lambda: U.linked_papers(g("source"), g("ids")),
        "rejected_mappings": lambda: U.rejected_mappings(g("ids")),
        "link_summary": lambda: U.link_summary(g("source"), g("ids")),
        "audit_links": lambda: g("links"),
        "audit_papers": lambda: g("papers"),
        "audit_mapping_summary": lambda: U.audit_mapping_summary(g("papers")),
        "audit_mapping_levels": lambda: U.audit_mapping_levels(g("papers")),
        "mapping_year_summary_by_year": lambda: U.audit_mapping_by_year(g("papers")),
        "mapping_year_summary_by_issn": lambda: U.audit_mapping_by_issn(g("papers")),
        "cohort_work_multiplicity_by_year": lambda: U.cohort_multiplicity_by_year(g("papers")),
        "inspection_work_details": lambda: U.inspection_work_details(g("links"), U.inspection_sample(g("papers"))),
        "audit_multiplicity": lambda: U.audit_multiplicity(g("ids"), g("papers")),
        "audit_year_patterns": lambda: U.audit_year_patterns(g("papers")),
        "audit_year_difference": lambda: U.audit_year_difference(g("links"), g("papers")),
        "audit_dates": lambda: U.audit_dates(g("papers")),
        "audit_doi_patterns": lambda: U.audit_doi_patterns(g("papers")),
        "inspection_sample": lambda: U.inspection_sample(g("papers")),
        "audit_accounting": lambda: U.audit_accounting(g("links"), g("papers")),
        "audit3_rows": lambda: g("audit3"),
        "audit3_status_by_year": lambda: U.audit3_status_by_year(g("audit3")),
        "audit3_differences": lambda: U.audit3_differences(g("audit3")),
        "paper_master": lambda: g("master"),
        "master_exclusions": lambda: M.master_exclusions({"annotation": g("focal_papers")}, g("matches"), g("works_of_papers"), g("source")),
        "sample_flow": lambda: M.sample_flow({"annotation": g("focal_papers")}, g("matches"), g("works_of_papers"), g("source")),
        "master_by_year": lambda: M.master_by_year(g("master")),
        "shared_metric_conflicts": lambda: M.shared_metric_conflicts(g("modules")),
        "overall_profile": lambda: R.overall_profile(g("profiled").select(*P.PROFILED), g("profiled_once")),
        "retention_by_year": lambda: R.retention(g("profiled"), P.analysis_sample(g("profiled_once"), BAD_YEARS, BAD_PREDICATES), "PYEAR"),
        "retention_by_predicate": lambda: R.retention(g("profiled"), P.analysis_sample(g("profiled_once"), BAD_YEARS, BAD_PREDICATES), "PREDICATE"),
        "metric_rule_report": lambda: Q.metric_rule_report(g("adoption")),
        "annotation_flag_report": lambda: Q.annotation_flag_report(g("annotated")),
        "outcome_consistency_report": lambda: Q.conflict_report(g("transitions"), {"triple with several categories": (["PYEAR", "s", "p", "o"], ["edge_annotation"]), "triple with several outcomes": (["PYEAR", "s", "p", "o"], ["future_exact_triple_seen"]), "pair with several labels": (["PYEAR", "node_a", "node_b"], ["edge_annotation"])}),
        "recompute_report": lambda: Q.recompute_report(g("paper_metrics").select(*stored), g("knowledge").select(*stored), "PMID"),
        "combine_report": lambda: Q.combine_report(g("paper_metrics"), t.years("PYEAR", first=W)),
        "year_bounds_report": lambda: Q.year_bounds_report(g("knowledge"), B.year_new_knowledge(g("annotated"))),
        "network_checks": lambda: K.network_checks(g("edges"), g("nodes"), g("profile"), W),
    }


def _numeric_references(t: Tables) -> DataFrame:
    return T.references(t.spark, t.dir).selectExpr("cast(substr(work_id, 2) as bigint) work", "referenced_work_id")


def _raw_lines(t: Tables, raw: DataFrame) -> DataFrame:
    """Statements as lines of text, some with a field too few or too many, read back."""
    columns = [c for c in PREDICATION_COLUMNS if c in raw.columns]
    quoted = [F.coalesce(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')), F.lit("\\N")) for c in columns]
    paper = F.col("PMID").cast("long")
    line = F.when(paper % 97 == 0, F.concat_ws(",", *quoted[:-1])).when(paper % 89 == 0, F.concat_ws(",", *quoted, F.lit("more"))).otherwise(F.concat_ws(",", *quoted))
    path = shared_path(t.spark, "raw")
    raw.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return read_raw_csv(t.spark, path, columns, "bad_line")


def _stored_vectors(t: Tables, labels: DataFrame) -> DataFrame:
    """Labels put into a store in two runs, the second of which has the first's again; the norm of each and the run that encoded it."""
    store = shared_path(t.spark, "vectors")
    for run, some in ((1, labels.filter(F.startswith("primary_cui", F.lit("C")))), (2, labels)):
        V.add_texts(some, store, "trigrams", V.trigram_encoder, S.DIMENSIONS, run, {"grams": 3}, "label")
    return V.vectors(t.spark, store, "trigrams").select("text", "run", F.round(S.norm(F.col("vector")), 6).alias("norm"), F.size("vector").alias("dimensions"))


def _range_of(t: Tables, df: DataFrame, column: str, rows: int, low: int, high: int) -> DataFrame:
    """Some rows of a table that is written in order first."""
    path = shared_path(t.spark, "shards")
    write_shards(df, path, [column], rows)
    return read_range(t.spark, path, column, low, high)


def _published(t: Tables, df: DataFrame, rules: dict) -> DataFrame:
    """A table as its readers find it once it is published."""
    path = shared_path(t.spark, "published")
    publish(df, path, rules, lambda files: Q.uniqueness_report({"paper": (files, ["PMID"])}), ["PMID"])
    return read_published(t.spark, path)


def _by_year(t: Tables, df: DataFrame, first: int, last: int) -> DataFrame:
    """Some years of a table that is written by year first."""
    path = shared_path(t.spark, "years")
    write_table(df, path, partition=["PYEAR"])
    return read_years(t.spark, path, first, last).withColumn("PYEAR", F.col("PYEAR").cast("string"))


def _from_json(t: Tables, works: DataFrame) -> DataFrame:
    """Works that are written as a snapshot of compressed JSON lines first."""
    root = shared_path(t.spark, "snapshot")
    works.write.json(f"{root}/data/works/updated_date=2024-01-01", compression="gzip")
    return read_snapshot(t.spark, root, "works", X.WORK_SCHEMA)


def _named(df: DataFrame) -> DataFrame:
    """The long names of the triple's columns."""
    return df.withColumnsRenamed({k: v for k, v in LONG.items() if k in df.columns})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _named(_plans(Tables(spark, sf_dir, name in ONCE, SHARED.get(name, ())))[name]())

    return {name: bound(name) for name in _plans(Tables(None, ""))}  # type: ignore[arg-type]

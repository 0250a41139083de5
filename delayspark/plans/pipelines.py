"""Composed jobs (M1-M9): what a user of the library runs end to end.

Each function wires operators into one lazy plan.  Fit statistics (modes, medians, quantiles, means) are scalar
subqueries of that plan: building it runs no job, and a report that does not read a fitted column does not fit
it.  Nothing here collects rows to the driver.

Lineage: the incident pipeline is a straight line of projections, and each fit reads only the one or two columns it
needs (column pruning down to the Parquet scan), so re-running the upstream plan for a fit is cheaper than
materialising the wide intermediate table.  Reports that share an input share its fits through a store
(:func:`fit_incidents`).  ``processed_table(..., materialize=True)`` writes the result to the shared checkpoint
folder (a reliable cut of lineage) for reuse by several reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import catalogue as CAT
from ..operators import clean as C
from ..operators import conform as B
from ..operators import crosstab as X
from ..operators import fits
from ..operators import profile as P
from ..operators import scaling as S
from ..operators import web as W
from ..operators.features import add_calendar, amount_features, category_code
from ..operators.fits import FitStore
from ..operators.stats import exact_quantiles, fill_maps, fill_with_group_stats
from ..schema import CORR_APPENDIX, CORR_FEATURES, NORMALISATION_FEATURES, PROCESSED_COLUMNS
from ..session import cut_lineage


# columns of reports that name a row although they are numbers
REPORT_KEYS = ("Year", "Month", "Hour", "bin")


def unify(frames, lo: int = 2017, hi: int = 2025, split_period=None, sort: bool = True) -> DataFrame:
    """M1: conform, union, parse, year filter, sort."""
    return B.unify(frames, lo, hi, split_period, sort)


QUARTILES = [0.25, 0.5, 0.75]
FILLS = {"Min Delay": "delay_medians", "Min Gap": "gap_medians", "Vehicle": "vehicle_modes"}
# fitted inputs of the processed columns that have any, and the fit of a column's own
INPUTS = {"Vehicle": ["Vehicle"], "Vehicle_Scaled": ["Vehicle"], "Min Delay": ["Min Delay"], "Min_Delay_Log": ["Min Delay"],
          "Delay_Category": ["Min Delay"], "Min Gap": ["Min Gap"], "Min_Gap_Scaled": ["Min Gap"],
          "Delay_Ratio": ["Min Delay", "Min Gap"], "Delay_Ratio_Scaled": ["Min Delay", "Min Gap"]}
OWN = {"Vehicle_Type_Encoded": "vehicle_types", "Min_Gap_Scaled": "gap_quartiles", "Delay_Ratio_Scaled": "ratio_quartiles",
       "Vehicle_Scaled": "vehicle_moments"}


class Incidents:
    """M2-M4 over one unified table, with the fits that the asked columns need.

    Fits are scalar subqueries (or read from a ``store``), made when first asked for.  Those of encoding and
    scaling get the narrowest form of the cleaned table: the type, the date and the columns that their own
    value is derived from, with their fills."""

    def __init__(self, unified: DataFrame, approx: bool = False, store: FitStore | None = None):
        self.unified, self.approx, self.store = unified, approx, store
        self.fitted: dict[str, Column] = {} if store is None else {n: store[n] for n in store.names()}

    def fit(self, name: str) -> Column:
        if name not in self.fitted:
            self.fitted[name] = self._fit(name)
        return self.fitted[name]

    def cleaned(self, columns) -> DataFrame:
        """The type, the date and the fitted ``columns``, cleaned."""
        names = [c for c in self.unified.columns if c in {"Vehicle_Type", "Date", *columns}]
        out = C.drop_null_date(self.unified.select(*[F.col(f"`{c}`") for c in names]))
        return fill_with_group_stats(out, [c for c in columns if c != "Vehicle"], [c for c in columns if c == "Vehicle"],
                                     fitted={c: self.fit(FILLS[c]) for c in columns})

    def _fit(self, name: str) -> Column:
        if name == "vehicle_modes":
            return fill_maps(self.unified, [], ["Vehicle"])["Vehicle"]
        if name in FILLS.values():
            col = next(c for c, n in FILLS.items() if n == name)
            return fill_maps(self.unified, [col], approx=self.approx)[col]
        if name == "vehicle_types":
            return fits.sorted_values(self.cleaned([]), "Vehicle_Type")
        if name == "vehicle_moments":
            return fits.moments(self.cleaned(["Vehicle"]), "Vehicle")
        if name == "gap_quartiles":
            return self._quartiles(self.cleaned(["Min Gap"]), "Min Gap")
        return self._quartiles(self.cleaned(["Min Delay", "Min Gap"]).withColumn("Delay_Ratio", fx.delay_ratio()), "Delay_Ratio")

    def _quartiles(self, df: DataFrame, col: str) -> Column:
        q = exact_quantiles(df, col, QUARTILES, approx=self.approx)
        return q.select(F.array("q0", "q1", "q2")).scalar()

    def table(self, columns=PROCESSED_COLUMNS, scaled: bool = True) -> DataFrame:
        """Cleaned and featured rows with ``columns`` (among others, which the optimizer drops when they are not read), scaled if asked for."""
        inputs = list(dict.fromkeys(i for c in columns for i in INPUTS.get(c, [])))
        names = [c for c in self.unified.columns if c not in FILLS or c in inputs]
        # fills and what follows them come last: Spark checks the subqueries of a plan again with each step on it
        out = add_calendar(C.drop_null_date(C.fill_unknown(self.unified.select(*[F.col(f"`{c}`") for c in names]))))
        out = fill_with_group_stats(out, [c for c in inputs if c != "Vehicle"], [c for c in inputs if c == "Vehicle"],
                                    fitted={c: self.fit(FILLS[c]) for c in inputs})
        made = amount_features(out.columns)
        if "Vehicle_Type_Encoded" in columns:
            made["Vehicle_Type_Encoded"] = category_code("Vehicle_Type", self.fit("vehicle_types"))
        if scaled and "Min_Delay_Log" in columns:
            made["Min_Delay_Log"] = S.log1p("Min Delay")
        out = out.withColumns(made) if made else out
        if not scaled:
            return out
        # each fit stands in the plan once, as a column that the scaled one reads
        given = {f"__{n}": self.fit(OWN[n]) for n in ("Min_Gap_Scaled", "Delay_Ratio_Scaled", "Vehicle_Scaled") if n in columns}
        out = out.withColumns(given) if given else out
        scalers = {}
        if "Min_Gap_Scaled" in columns:
            scalers["Min_Gap_Scaled"] = S.apply_robust("Min Gap", S.robust_params(out, "Min Gap", fitted=F.col("__Min_Gap_Scaled")))
        if "Delay_Ratio_Scaled" in columns:
            scalers["Delay_Ratio_Scaled"] = S.apply_robust("Delay_Ratio", S.robust_params(out, "Delay_Ratio", fitted=F.col("__Delay_Ratio_Scaled")))
        if "Vehicle_Scaled" in columns:
            scalers["Vehicle_Scaled"] = S.apply_standard("Vehicle", S.standard_params(out, "Vehicle", fitted=F.col("__Vehicle_Scaled")))
        return out.withColumns(scalers).drop(*given) if scalers else out


def fit_incidents(unified: DataFrame, path: str) -> FitStore:
    """All fits over one unified table, run once and kept below ``path``: first those of cleaning, then the others on top of them."""
    store = FitStore(unified.sparkSession, path)
    first = Incidents(unified)
    store.put(**{n: first.fit(n) for n in FILLS.values()})
    then = Incidents(unified, store=store)
    return store.put(**{n: then.fit(n) for n in OWN.values()})


def clean_and_feature(unified: DataFrame) -> DataFrame:
    """M2 + M3."""
    return Incidents(unified).table(scaled=False)


def processed_table(unified: DataFrame, materialize: bool = False, approx: bool = False, store: FitStore | None = None,
                    columns=PROCESSED_COLUMNS) -> DataFrame:
    """M2 + M3 + M4 (+B4): clean, engineer features, scale; the 37 saved columns.

    A fit whose column nobody reads is pruned; naming the ``columns`` that a report needs spares Spark the planning of
    the others' fits as well (driver seconds, the same at any size).  With a ``store`` nothing is fitted."""
    out = B.select_available(Incidents(unified, approx, store).table(columns), [c for c in PROCESSED_COLUMNS if c in set(columns)])
    return cut_lineage(out) if materialize else out


def profile(processed: DataFrame, features=NORMALISATION_FEATURES, types=None) -> dict[str, DataFrame]:
    """M5: the reports behind the notebook's charts, each a small DataFrame
    (crosstabs in long form, or wide over the given vehicle ``types``)."""
    sizes = P.group_size(processed, "Year")
    return {
        "describe_target": P.describe(processed, "Min Delay"),
        "delay_categories": P.value_counts_cat(processed, "Delay_Category"),
        "delay_category_pct": P.value_pct_nonnull(processed, "Delay_Category"),
        "vehicle_types": P.value_counts(processed, "Vehicle_Type"),
        "vehicle_type_pct": P.value_pct_rows(processed, "Vehicle_Type"),
        "normalisation": P.normalisation_assessment(processed, features),
        "crosstab": X.crosstab_margins(processed, values=types) if types else X.crosstab_long(processed),
        "crosstab_pct": X.crosstab_row_pct(processed, values=types) if types else X.crosstab_long(processed),
        "year_sizes": sizes,
        "extremes": P.extremes_of_counts(sizes),
        "growth": P.yoy_growth(sizes),
        "cv_by_year": X.cv_by_year(processed),
        "correlation": P.correlation_matrix(processed, CORR_FEATURES),
        "correlation_target": P.correlation_target(processed, CORR_FEATURES),
        "correlation_appendix": P.correlation_matrix(processed, CORR_APPENDIX),
        "by_month": P.mean_by_key(processed, "Month"),
        "by_day": P.reindex_days(P.mean_by_key(processed, "DayName")),
        "by_hour": P.mean_by_key(processed, "Hour"),
        "by_type": P.mean_by_key(processed, "Vehicle_Type"),
        "histogram": P.histogram(processed, "Min Delay"),
        "date_range": P.date_range(processed),
        "missing": C.missing_profile(processed),
    }


def profile_figures(unified: DataFrame, path: str) -> DataFrame:
    """M5 as one job: every report of :func:`profile` over the processed table of ``unified``, its fits kept below ``path``
    and shared, as long rows (report, item, figure, value).  ``item`` is a row's texts and keys, ``figure`` the name of a number."""
    processed = processed_table(unified, store=fit_incidents(unified, path))
    out = None
    for name, df in profile(processed).items():
        keys = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "boolean", "date") or f.name in REPORT_KEYS]
        numbers = [f.name for f in df.schema.fields if f.name not in keys]
        cells = F.array(*[F.struct(F.lit(n).alias("figure"), F.col(f"`{n}`").cast("double").alias("value")) for n in numbers]
                        or [F.struct(F.lit("").alias("figure"), F.lit(None).cast("double").alias("value"))])
        item = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-")) for k in keys])
        long = df.select(F.lit(name).alias("report"), item.alias("item"), F.explode(cells).alias("c")).select("report", "item", "c.figure", "c.value")
        out = long if out is None else out.unionByName(long)
    return out


def catalogue(search_records: DataFrame) -> DataFrame:
    """M6: flattened catalogue of datasets with a CSV resource."""
    return CAT.dataset_info(search_records)


def enrich_catalogue(datasets: DataFrame, packages: DataFrame, fields: DataFrame, records: DataFrame,
                     done: DataFrame | None = None, policy: str = "first") -> DataFrame:
    """M7: resume (D3), enrich (D2) and summarise per dataset."""
    todo = CAT.resume_remaining(datasets, done) if done is not None else datasets
    return CAT.enrich(todo, packages, fields, records, policy)


def link_manifest(pages: DataFrame, existing: DataFrame | None = None, lenient: bool = False) -> DataFrame:
    """M8: download links, file names, skip/collision status."""
    return W.link_manifest(pages, existing, lenient=lenient)


FIGURES = ["overall_score", "grade", "freshness", "metadata", "accessibility", "completeness", "usability",
           "last_refreshed"]


def supplement(enriched: DataFrame, resource_pages: DataFrame) -> DataFrame:
    """M9: fill what enrichment left empty from captured resource pages.

    ``resource_pages``: (name, rpos, title, html) - a captured page per
    resource - or, instead of html, the ``rows`` and ``figures`` of
    :func:`web.page_facts`.  Readme and blank headings are skipped (C6); for a
    dataset still missing a dictionary, the first resource whose page has
    table rows (J4) supplies it; for one missing quality, the first page with
    any quality figure (J5) does.  Markup is read inside each row; only rows
    and figures are shuffled.  Output: name, dictionary (list of row,
    column_name, type, description), dictionary_columns, dictionary_rpos,
    quality_rpos and the eight figures."""
    needing = CAT.needs_enrichment(enriched).select("name", "n_dictionary", "has_quality")
    pages = CAT.not_readme(resource_pages, "title")
    facts = W.page_facts(pages) if "html" in pages.columns else pages
    any_figure = F.coalesce(*[F.col(f"figures.{c}") for c in FIGURES]).isNotNull()
    with_rows = F.when(F.size("rows") > 0, F.col("rpos"))
    with_figure = F.when(any_figure, F.col("rpos"))
    best = (facts.select("name", "rpos", "rows", "figures").where((F.size("rows") > 0) | any_figure)
            .groupBy("name").agg(F.min_by("rows", with_rows).alias("rows"), F.min(with_rows).alias("dictionary_rpos"),
                                 F.min_by("figures", with_figure).alias("figures"), F.min(with_figure).alias("quality_rpos")))
    out = needing.join(best, "name", "left")
    no_dict, no_quality = F.col("n_dictionary") == 0, ~F.col("has_quality")
    return out.select(
        "name", F.when(no_dict, F.col("rows")).alias("dictionary"),
        F.when(no_dict & F.col("rows").isNotNull(), F.size("rows")).otherwise(F.lit(0)).alias("dictionary_columns"),
        F.when(no_dict, F.col("dictionary_rpos")).alias("dictionary_rpos"),
        F.when(no_quality, F.col("quality_rpos")).alias("quality_rpos"),
        *[F.when(no_quality, F.col(f"figures.{c}")).alias(c) for c in FIGURES])

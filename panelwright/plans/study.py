"""The whole study: source tables in, cohort, visit-days, cause shares, panels and model inputs out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import constants as C
from panelwright.functions.codes import clean_code, is_member, is_missing_code, is_remote
from panelwright.functions.dates import in_years, month_start, parse_visit_date, run_month, run_quarter
from panelwright.functions.means import safe_log
from panelwright.functions.recode import recode
from panelwright.operators import cleaning, code_map, impute, joins, panel, patient_days, policy
from panelwright.operators.fixed_effects import EventStudy
from panelwright.operators.gram import Model, fit_models
from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.readers import list_to_codes
from panelwright.sources.writers import settle

PATIENT = ["client_id", "client_patient_id"]
MODIFIERS = ["modifier_code1", "modifier_code2", "modifier_code3", "modifier_code4"]
COVARIATES = ["lpatients", "pct_below18", "pct_65plus", "wnh", "bnh", "hispanic", "change_patients"]


@dataclass(frozen=True)
class Study:
    """Calendar and sizes of a study. ``anchor`` is the month before the first study month."""

    anchor: dt.date = dt.date(2018, 12, 1)
    years: Sequence[int] = (2019, 2020, 2021, 2022, 2023)
    end: dt.date = dt.date(2023, 4, 1)
    baseline_end: dt.date = dt.date(2020, 1, 1)
    pandemic_start: dt.date = dt.date(2020, 3, 1)
    pandemic_second: dt.date = dt.date(2020, 7, 1)
    early_end: dt.date = dt.date(2020, 7, 1)
    alternative_end: dt.date = dt.date(2021, 6, 1)
    age_year: int = 2020
    m: int = 10
    seed: int = 7
    small_below: float = C.SMALL_NETWORK_PATIENT_DAYS
    white_above: float = C.MORE_WHITE_SHARE

    @property
    def start(self) -> dt.date:
        return dt.date(self.years[0], 1, 1)

    def shifted(self, years: int) -> Study:
        """The same study moved by whole years."""
        def move(d: dt.date) -> dt.date:
            return d.replace(year=d.year + years)

        return Study(move(self.anchor), tuple(y + years for y in self.years), move(self.end), move(self.baseline_end),
                     move(self.pandemic_start), move(self.pandemic_second), move(self.early_end),
                     move(self.alternative_end), self.age_year + years, self.m, self.seed,
                     self.small_below, self.white_above)


@dataclass(frozen=True)
class Sources:
    """The seven source tables, lower_snake columns."""

    client_dem: DataFrame
    demographic: DataFrame
    procedure: DataFrame
    orig_zips: DataFrame
    inpatient_codes: DataFrame
    icd_map: DataFrame
    causelist: DataFrame


class StudyTables:
    """Derived tables of a study, each built once as a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sources: Sources, study: Study):
        """``sources``: a ``Sources``, or any object with the same attributes."""
        self.spark, self.src, self.study = spark, sources, study

    # --- cohort -------------------------------------------------------------------------------------------------

    @cached_property
    def pulled(self) -> DataFrame:
        """Demographic rows of listed networks with at least one visit in the study years, and the visit count."""
        visits = (
            self.src.procedure.where(in_years(F.col("date"), self.study.years))
            .groupBy("client_id", F.col("patient_id").alias("client_patient_id"))
            .agg(F.count_distinct("date").alias("visit_count"))
        )
        listed = joins.keep_listed(self.src.demographic, self.src.client_dem, ["client_id"])
        return listed.distinct().join(visits, PATIENT)

    @cached_property
    def recoded(self) -> DataFrame:
        """One row per patient with race, ethnicity and language recoded and the postal area filled."""
        one = cleaning.keep_first(self.pulled, PATIENT, ["zip3"])
        language = F.col("primary_language")
        coded = one.select(
            *PATIENT, F.substring("dob", 1, 4).try_cast("int").alias("birth_year"), "gender", "visit_count",
            recode(F.col("race"), C.RACE_CODES).alias("race"),
            recode(F.col("ethnicity"), C.ETHNICITY_CODES).alias("hispanic"),
            is_member(language, ["eng"]).alias("lang_eng"), is_member(language, ["spa"]).alias("lang_spa"),
            is_member(language, C.ASIAN_LANGUAGES).alias("lang_asi"),
            F.col("zip3").try_cast("int").alias("zip3"))
        other = cleaning.keep_first(self.src.orig_zips, PATIENT, ["zip3"]).withColumn(
            "zip3", F.col("zip3").try_cast("int"))
        areas = self.src.client_dem.select("client_id", "zip3")
        return cleaning.fill_in_order(coded, "zip3", [(other, PATIENT, "zip3"), (areas, ["client_id"], "zip3")],
                                      drop_missing=False)

    @property
    def eligibility(self) -> dict[str, Column]:
        """The cohort's completeness filters, in order."""
        return {"zip3 known": F.col("zip3").isNotNull(), "gender known": F.col("gender") != "U",
                "birth year known": F.col("birth_year").isNotNull()}

    @cached_property
    def patients(self) -> DataFrame:
        """The cohort, written out: several branches start from it."""
        kept = self.recoded
        for condition in self.eligibility.values():
            kept = kept.where(condition)
        return settle(kept, "patients")

    @cached_property
    def completed(self) -> DataFrame:
        """Sparse imputed stack with the combined race/ethnicity group."""
        sparse = impute.open_copies(self.patients, ["race", "hispanic"], self.study.m)
        key = F.col("client_patient_id")
        race = impute.hot_deck(sparse, self.patients, "race", ["client_id"], key, self.study.seed)
        both = impute.hot_deck(race, self.patients, "hispanic", ["client_id", "race"], key, self.study.seed + 100)
        return both.withColumn("re", panel.combine_race(F.col("race"), F.col("hispanic")))

    # --- visits -------------------------------------------------------------------------------------------------

    @cached_property
    def excluded_codes(self) -> DataFrame:
        """Inpatient list united with the hospital and emergency codes."""
        listed = list_to_codes(self.src.inpatient_codes, "hcpcs_code", "cpt4_hcpcs_code")
        literals = self.spark.createDataFrame([(c,) for c in C.HOSPITAL_AND_EMERGENCY_CODES], "cpt4_hcpcs_code string")
        return listed.union(literals).distinct()

    @cached_property
    def outpatient(self) -> DataFrame:
        """Outpatient procedure rows of listed networks with a parsed date."""
        rows = joins.keep_listed(self.src.procedure, self.src.client_dem, ["client_id"])
        dated = rows.withColumn("visit_date", parse_visit_date(F.col("date"))).where(F.col("visit_date").isNotNull())
        return joins.drop_listed(dated, self.excluded_codes, "cpt4_hcpcs_code")

    @cached_property
    def code_dimension(self) -> DataFrame:
        return code_map.build_code_dimension(self.src.icd_map, self.src.causelist)

    @cached_property
    def mental_codes(self) -> DataFrame:
        return code_map.family_codes(self.code_dimension, C.MENTAL_FAMILY).select("icd_code").distinct()

    @cached_property
    def visit_days(self) -> DataFrame:
        """(client, patient, visit_date) with remote and mental-health flags, within the study years."""
        known = broadcast_if_small(self.mental_codes.select(F.col("icd_code").alias("dx"), F.lit(True).alias("mental")))
        rows = (
            self.outpatient.where(in_years(F.col("date"), self.study.years))
            .where(F.year("visit_date").isin(*self.study.years))
            .withColumn("dx", clean_code(F.col("dx1_code"))).join(known, "dx", "left")
            .withColumnRenamed("patient_id", "client_patient_id")
        )
        flags = {"telehealth": is_remote([F.col(c) for c in MODIFIERS], C.REMOTE_MODIFIERS),
                 "mentalhealth": F.coalesce("mental", F.lit(False))}
        return panel.visit_days(rows, [*PATIENT, "visit_date"], flags)

    @cached_property
    def patient_months(self) -> DataFrame:
        """Visit-days added up by patient and month, written out: all panels start from it."""
        months = self.visit_days.groupBy(*PATIENT, month_start(F.col("visit_date")).alias("month")).agg(
            F.count(F.lit(1)).alias("n_days"), F.sum("telehealth").alias("n_remote"),
            F.sum("mentalhealth").alias("n_mental"),
            F.sum(F.col("telehealth") * F.col("mentalhealth")).alias("n_mental_remote"))
        return settle(months, "patient-months")

    # --- cause shares -------------------------------------------------------------------------------------------

    def care_rows(self, remote: bool | None = None) -> DataFrame:
        """Outpatient rows in the study window, of one care type or of both; in-person is the exact complement."""
        flag = is_remote([F.col(c) for c in MODIFIERS], C.REMOTE_MODIFIERS, F.col("place_of_service"),
                         C.REMOTE_PLACE_OF_SERVICE)
        inside = (F.col("visit_date") >= F.lit(self.study.start)) & (F.col("visit_date") < F.lit(self.study.end))
        years = range(self.study.start.year, self.study.end.year + 1)
        rows = self.outpatient.where(in_years(F.col("date"), years)).where(inside).withColumn("remote", flag)
        return rows if remote is None else rows.where(F.col("remote") == remote)

    @cached_property
    def resolved_codes(self) -> DataFrame:
        return code_map.resolve_systems(self.code_dimension, "dx")

    def cause_weights(self, rows: DataFrame) -> DataFrame:
        """Exact patient-days by care type, month and cause family: (remote, plot_date, family_name, units)."""
        weights = patient_days.weight_codes(rows, ["remote", "client_id", "patient_id", "visit_date"], "dx1_code",
                                            is_missing_code(F.col("dx1_code"), C.REDACTED), whole="n_parts")
        coded = weights.withColumns({"dx": clean_code(F.col("dx1_code")),
                                     "plot_date": month_start(F.col("visit_date"))})
        mapped = patient_days.map_codes(coded, "dx", self.resolved_codes)
        named = mapped.withColumn("family_name", F.coalesce("family_name", F.lit(C.UNMAPPED)))
        return patient_days.exact_weights(named, ["remote", "plot_date", "family_name"], "n_rows", "n_parts")

    def cause_shares(self, rows: DataFrame) -> DataFrame:
        """Patient-days by care type, month and cause family: (remote, plot_date, family_name, weight, prop)."""
        return patient_days.cause_share(self.cause_weights(rows), ["remote", "plot_date"], "family_name", "units")

    @cached_property
    def care_weights(self) -> DataFrame:
        """Exact patient-days of both care types, from one pass over the rows: (care_type, plot_date, family_name, units)."""
        label = F.when(F.col("remote"), "Telemedicine").otherwise("In-Person")
        return self.cause_weights(self.care_rows()).withColumn("care_type", label).drop("remote")

    @cached_property
    def care_comparison(self) -> DataFrame:
        """Cause shares of both care types."""
        return patient_days.cause_share(self.care_weights, ["care_type", "plot_date"], "family_name", "units")

    # --- panels -------------------------------------------------------------------------------------------------

    @cached_property
    def by_group(self) -> DataFrame:
        """(client, month, re, imp)."""
        return panel.group_panel(self.patient_months, self.completed, self.study.m)

    @cached_property
    def measures(self) -> DataFrame:
        """(client, month) measures from the non-imputed columns."""
        return panel.client_measures(self.patient_months, self.patients)

    @cached_property
    def network_months(self) -> DataFrame:
        """Client x month with areas: the part of the panel that is the same in every copy."""
        rows = self.measures.where(F.col("month") < F.lit(self.study.end))
        return joins.natural_left_join(rows, self.src.client_dem, ["client_id"])

    @cached_property
    def assembled(self) -> DataFrame:
        """Client x month x imp before baseline ratios."""
        shares = panel.group_shares(self.by_group)
        areas = self.src.client_dem.select("client_id", "state", "zip3", "pct_rural_2010", "povertyrate")
        wide = joins.natural_left_join(shares, areas, ["client_id"])
        wide = joins.natural_left_join(wide, self.measures, ["client_id", "month"])
        cut = wide.where(F.col("month") < F.lit(self.study.end)).withColumns({
            "period": policy.pandemic_period(F.col("month"), self.study.pandemic_start, self.study.pandemic_second),
            "run_month": run_month(F.col("month"), self.study.anchor)})
        flags = {"small_below": self.study.small_below, "white_above": self.study.white_above}
        return panel.unit_flags(policy.attach_policy(cut, policy.policy_table(self.spark), "run_month"), **flags)

    @cached_property
    def baseline(self) -> DataFrame:
        """Client x imp summary of the baseline year."""
        columns = ["telehealth", "u65_telehealth", "mental_telehealth", "pct_female", "pct_below18", "pct_65plus",
                   *C.GROUPS]
        year = self.assembled.where(F.col("month") < F.lit(self.study.baseline_end))
        return panel.weighted_means(year, ["client_id", "imp"], columns, "mpatients", firsts=["state", "zip3"],
                                    extra=[F.sum("mpatients").alias("mpatients")])

    @cached_property
    def panel(self) -> DataFrame:
        """The analysis panel, client x month x imp, written out: every model starts from it."""
        ratios = panel.change_ratios(self.assembled, F.col("month") < F.lit(self.study.baseline_end))
        out = policy.attach_stringency(ratios, policy.stringency_table(self.spark), "month", self.study.pandemic_start)
        return settle(out, "panel")

    @cached_property
    def state_months(self) -> DataFrame:
        columns = ["telehealth", "pct_below18", "pct_65plus", "pct_female", *C.GROUPS, "pct_rural_2010", "povertyrate",
                   "change_patients", "small", "poverty", "rural"]
        return panel.weighted_means(self.panel, ["month", "state", "imp"], columns, "mpatients",
                                    firsts=["parity", "parity_group", "run_month", "parity_month"],
                                    extra=[F.sum("mpatients").alias("mpatients")])

    @cached_property
    def group_rates(self) -> DataFrame:
        rates = panel.group_rates(self.by_group).where(F.col("month") < F.lit(self.study.end))
        return rates.withColumn("label", recode(F.col("re"), C.GROUP_LABELS))

    # --- model inputs -------------------------------------------------------------------------------------------

    @property
    def quarters(self) -> list[int]:
        months = (self.study.end.year - self.study.start.year) * 12 + self.study.end.month - 1
        return list(range(1, (months + 2) // 3 + 1))

    def _quarterly(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "quarter": run_quarter(F.col("month"), self.study.years[0]),
            "telehealth": F.col("telehealth") * 100,
            "u65_telehealth": F.col("u65_telehealth") * 100,
            "parity_combined": F.when(F.col("parity_group") == C.GROUP_NEVER, 0).otherwise(1)})

    def client_quarters(self, rows: DataFrame) -> DataFrame:
        """Client x quarter x imp means for the client-level models."""
        means = ["telehealth", "u65_telehealth", "mpatients", "pct_below18", "pct_65plus", "wnh", "bnh", "hispanic",
                 "change_patients", "index", "rural", "small", "poverty", "more_wnh"]
        firsts = ["parity_group", "parity_combined", "pct_rural_2010", "povertyrate"]
        grouped = panel.plain_means(self._quarterly(rows), ["client_id", "quarter", "imp"], means, firsts=firsts)
        return settle(grouped.withColumn("lpatients", safe_log(F.col("mpatients"))), "client-quarters")

    def state_quarters(self, rows: DataFrame) -> DataFrame:
        """State x quarter x imp weighted means for the state-level models."""
        means = ["telehealth", "pct_below18", "pct_65plus", "wnh", "bnh", "hispanic", "change_patients", "index",
                 "pct_rural_2010", "povertyrate"]
        grouped = panel.weighted_means(
            self._quarterly(rows), ["state", "quarter", "imp"], means, "mpatients", lenient=True,
            firsts=["parity_group", "parity_combined"], extra=[safe_log(F.sum("mpatients")).alias("lpatients")])
        return settle(grouped, "state-quarters")

    @cached_property
    def early_rows(self) -> DataFrame:
        """Before the wave of policies: early adopters against states without one."""
        rows = self.panel.where((F.col("parity_group") != C.GROUP_WAVE)
                                & (F.col("month") < F.lit(self.study.early_end)))
        treated = (F.col("parity_group") == C.GROUP_BEFORE) | (F.col("state") == "GA")
        return rows.withColumn("parity_group", F.when(treated, "Early").otherwise(C.GROUP_NEVER))

    @cached_property
    def main_rows(self) -> DataFrame:
        """Main model groups: one late state joins the wave, other dates are left out."""
        moved = policy.regroup_states(self.panel, {"GA": C.GROUP_WAVE})
        return moved.where(F.col("parity_group") != C.GROUP_OTHER)

    @cached_property
    def alternative_rows(self) -> DataFrame:
        """Late adopters counted as controls, cut before the first of them changes."""
        late = {s: C.GROUP_NEVER for s in ("NY", "MD", "OK", "OR")}
        moved = policy.regroup_states(self.panel, {**late, "GA": C.GROUP_WAVE})
        return moved.where((F.col("parity_group") != C.GROUP_OTHER)
                           & (F.col("month") < F.lit(self.study.alternative_end)))

    def _row_sets(self) -> dict[str, tuple[Column, Column]]:
        """Rows of the models by name: (kept, policy group), the groups as in the ``*_rows`` tables."""
        group, state, month = F.col("parity_group"), F.col("state"), F.col("month")
        late = {s: C.GROUP_NEVER for s in ("NY", "MD", "OK", "OR")}
        main = recode(state, {"GA": C.GROUP_WAVE}, group)
        moved = recode(state, {**late, "GA": C.GROUP_WAVE}, group)
        early = F.when((group == C.GROUP_BEFORE) | (state == "GA"), C.GROUP_BEFORE).otherwise(C.GROUP_NEVER)
        return {"main": (main != C.GROUP_OTHER, main),
                "alternative": ((moved != C.GROUP_OTHER) & (month < F.lit(self.study.alternative_end)), moved),
                "early": ((group != C.GROUP_WAVE) & (month < F.lit(self.study.early_end)), early)}

    def model_panel(self, sets: Sequence[str], states: bool = False) -> DataFrame:
        """(rows, unit, quarter, imp, means, treatments) for all models over the named row sets, from one read of the panel.

        A panel row is carried once for each of its row sets, then averaged by quarter. ``states`` adds the state-level means
        of the main rows as row set ``state``.
        """
        chosen = {name: self._row_sets()[name] for name in sets}
        copies = F.array(*[F.when(kept, F.struct(F.lit(name).alias("rows"), group.alias("parity_group"))) for name, (kept, group) in chosen.items()])
        rows = self.panel.withColumn("_s", F.explode(F.array_compact(copies))).withColumns({"rows": F.col("_s.rows"), "parity_group": F.col("_s.parity_group")})
        means = ["telehealth", "u65_telehealth", "mpatients", "pct_below18", "pct_65plus", "wnh", "bnh", "hispanic",
                 "change_patients", "index", "rural", "small", "poverty", "more_wnh"]
        out = panel.plain_means(self._quarterly(rows.drop("_s")), ["rows", "client_id", "quarter", "imp"], means, firsts=["parity_group"])
        out = out.withColumns({"unit": F.col("client_id").cast("string"), "lpatients": safe_log(F.col("mpatients"))}).drop("client_id")
        if states:
            by_state = self.state_quarters(self.main_rows).withColumns({"rows": F.lit("state"), "unit": F.col("state")})
            out = out.unionByName(by_state.select([c for c in out.columns if c in by_state.columns]), allowMissingColumns=True)
        is_group = lambda g: (F.col("parity_group") == g).cast("int")
        return out.withColumns({C.GROUP_BEFORE: is_group(C.GROUP_BEFORE), C.GROUP_WAVE: is_group(C.GROUP_WAVE),
                                C.GROUP_EARLY_OR_WAVE: 1 - is_group(C.GROUP_NEVER)})

    def models(self) -> dict[str, Model]:
        """All fixed-effects models of the study by name: per policy group and for all treated groups together."""
        quarters, covariates = tuple(self.quarters), (*COVARIATES, "index")
        groups, combined = (C.GROUP_BEFORE, C.GROUP_WAVE), (C.GROUP_EARLY_OR_WAVE,)
        out = [Model("early", "early", "telehealth", (1, 2, 3, 4, 5, 6), (C.GROUP_BEFORE,), tuple(COVARIATES))]
        for name, rows, outcome, periods in (("client", "main", "telehealth", quarters), ("state", "state", "telehealth", quarters),
                                             ("under_65", "main", "u65_telehealth", quarters),
                                             ("alternative", "alternative", "telehealth", tuple(range(1, 11)))):
            out += [Model(f"{name}_groups", rows, outcome, periods, groups, covariates), Model(f"{name}_combined", rows, outcome, periods, combined, covariates)]
        out += [Model(m, "main", "telehealth", quarters, combined, covariates, m) for m in ("rural", "small", "poverty", "more_wnh")]
        return {m.name: m for m in out}

    def fits(self, names: Sequence[str]) -> DataFrame:
        """Coefficients of the named models, all from one pass (see ``gram.fit_models``)."""
        models = [self.models()[n] for n in names]
        sets = [s for s in self._row_sets() if any(m.rows == s for m in models)]
        return fit_models(self.model_panel(sets or ["main"], any(m.rows == "state" for m in models)), models)

    def group_study(self, unit: str = "client_id", outcome: str = "telehealth", quarters: Sequence[int] | None = None,
                    covariates: Sequence[str] = (*COVARIATES, "index")) -> EventStudy:
        """One effect per policy group and quarter."""
        groups = [(g, F.when(F.col("parity_group") == g, 1).otherwise(0)) for g in (C.GROUP_BEFORE, C.GROUP_WAVE)]
        return EventStudy(outcome, unit, "quarter", quarters or self.quarters, groups, covariates)

    def combined_study(self, unit: str = "client_id", outcome: str = "telehealth",
                       quarters: Sequence[int] | None = None, covariates: Sequence[str] = (*COVARIATES, "index"),
                       moderator: str | None = None) -> EventStudy:
        """One effect per quarter for all treated groups together."""
        treated = [(C.GROUP_EARLY_OR_WAVE, F.col("parity_combined"))]
        return EventStudy(outcome, unit, "quarter", quarters or self.quarters, treated, covariates, moderator)

    def matching_panel(self, drop_wave: bool, first_untreated: int | None) -> DataFrame:
        """Monthly panel with percent outcomes, log size and the treatment indicator."""
        rows = self.panel.where(F.col("parity_group") != C.GROUP_WAVE) if drop_wave else self.panel
        return rows.withColumns({
            "telehealth": 100 * F.col("telehealth"), "u65_telehealth": 100 * F.col("u65_telehealth"),
            "mental_telehealth": 100 * F.col("mental_telehealth"), "lpatients": safe_log(F.col("mpatients")),
            "treatment": policy.treatment_indicator(F.col("parity_month"), F.col("run_month"), first_untreated)})

"""Stage tables that several registered queries start from, computed once per query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.catalog.views import Tables
from claimscope.operators import claims as C
from claimscope.operators import networks as N
from claimscope.operators.networks import Networks
from claimscope.plans import cohort as HH
from claimscope.plans import networks as NET
from claimscope.plans import providers as P
from claimscope.session import cut

AS_OF = "2026-02-09"
# With this gate some codes of the test tables have enough peers and others have not.
GATE = 97
LOCAL_STATES = ["NATION_2", "NATION_7", "NATION_12", "NATION_17", "NATION_22"]
DEEP_DIVE_CODE = "Brand#11:SMALL"
# Results already computed in this application, by application, folder and stage: later queries read the stored table.
_STORED: dict[tuple[str, str, str], object] = {}


def clear() -> None:
    _STORED.clear()


def _stored(t: Tables, name: str, build):
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def codes(t: Tables) -> DataFrame:
    return _stored(t, "codes", lambda: cut(C.provider_code(t.claims)))


def features(t: Tables) -> DataFrame:
    return _stored(t, "features", lambda: cut(P.provider_features(t.claims, t.providers, t.deactivated, AS_OF, GATE)))


def scores(t: Tables) -> DataFrame:
    return _stored(t, "scores", lambda: cut(P.score_providers(features(t))))


def baseline(t: Tables) -> DataFrame:
    """Features with the z-score count and rank, which SQL can check; ranks by payments stand in for the model's."""
    from claimscope.operators.ranking import Rank, global_ranks

    def build() -> DataFrame:
        base = cut(features(t).join(P.zscore_baseline(features(t)), "billing_npi"))
        return cut(global_ranks(base, ["billing_npi"], {
            "paid_rank": Rank("total_paid", "average_floor"), "peer_rank": Rank("max_peer_zscore", "average_floor"),
        }))

    return _stored(t, "baseline", build)


def cohort_claims(t: Tables) -> DataFrame:
    return _stored(t, "cohort_claims", lambda: cut(
        C.categorize(HH.extract_cohort_claims(t.claims, t.providers), t.code_categories)
    ))


def cohort_prices(t: Tables) -> DataFrame:
    return _stored(t, "cohort_prices", lambda: cut(HH.cohort_prices(cohort_claims(t))))


def cohort(t: Tables) -> DataFrame:
    return _stored(t, "cohort", lambda: cut(HH.scored_cohort(cohort_claims(t))))


def local_cohort(t: Tables) -> DataFrame:
    return _stored(t, "local_cohort", lambda: cut(
        HH.scored_cohort(C.scope_state(cohort_claims(t), LOCAL_STATES, "provider_state"))
    ))


def networks(t: Tables) -> Networks:
    return _stored(t, "networks", lambda: NET.build_networks(t.orgs))


def deactivated_persons(t: Tables) -> DataFrame:
    return N.deactivated_individuals(t.individuals, t.deactivated)


@dataclass(frozen=True)
class Layer3:
    networks: Networks
    individual: DataFrame
    organisation: DataFrame
    deactivated: DataFrame
    exposure: DataFrame
    scored: DataFrame


def layer3(t: Tables) -> Layer3:
    def build() -> Layer3:
        nets = networks(t)
        individual, organisation = (cut(m) for m in NET.match_exclusions(nets, t.orgs, t.exclusions))
        gone = cut(NET.match_deactivated(nets, deactivated_persons(t)))
        exposure = cut(NET.spending_exposure(t.org_claims, nets))
        frequency = N.name_frequency(N.individuals(t.individuals))
        scored = cut(NET.network_risk(nets, individual, organisation, gone, exposure, frequency))
        return Layer3(nets, individual, organisation, gone, exposure, scored)

    return _stored(t, "layer3", build)

"""Stage settings of the four domains.

The borders of the domains themselves are the user's rules (``filters.domain_split``).
"""

from pyspark.sql import functions as F

from ..operators import augment, filters
from ..operators.cascade import Flow, Stage
from ..operators.kernel import MarginSVC

# Domain, groups, columns, kernel width, penalty, class weights.
DOMAIN_1_Q_LIMIT = 1.066
DOMAIN_2_LINE = ((0.545, 0.15), (0.945, 0.95))  # in (a, q)
SETTINGS = {
    "1-apollo": dict(cols=["w", "q", "i"], gamma=40.0, C=0.05, classWeight={0: 1.2}),
    "1-apollo-rest": dict(cols=["w", "q", "a"], gamma=40.0, C=0.1, classWeight={0: 1.5}),
    "1-amor": dict(cols=["w", "i"], gamma=30.0, C=0.1, classWeight={1: 5.5}),
    "1-amor-inside": dict(cols=["w", "om", "q"], gamma=20.0, C=8.0, classWeight={0: 2.4}),
    "1-mask": dict(cols=["w", "q"], gamma=10.0, C=1e3),
    "2-atira-aten": dict(cols=["w", "a", "i"], gamma=80.0, C=0.1, classWeight={0: 1.5}),
    "2-atira-aten-rest": dict(cols=["a", "q"], gamma=8.0, C=1000.0, classWeight={0: 1.5}),
    "2-apollo": dict(cols=["w", "i"], gamma=30.0, C=0.1, classWeight={0: 10}),
    "2-apollo-rest": dict(cols=["w", "q", "i"], gamma=100.0, C=2.0, classWeight={0: 1.5}),
    "2-apollo-4d": dict(cols=["w", "q", "i", "a"], gamma=80.0, C=10.0),
    "2-mask": dict(cols=["w", "q"], gamma=10.0, C=100.0, classWeight={1: 10}),
    "3-atira-aten": dict(cols=["w", "i"], gamma=80.0, C=0.4, classWeight={0: 1.1}),
    "3-apollo": dict(cols=["w", "q", "i"], gamma=20.0, C=0.5),
    "3-mask": dict(cols=["w", "q"], gamma=10.0, C=500.0, classWeight={1: 10}),
}


def estimator(name: str, features: int = 1024) -> MarginSVC:
    """Kernel machine with the settings of a stage or mask."""
    given = {k: v for k, v in SETTINGS[name].items() if k != "cols"}
    return MarginSVC(numFeatures=features, **given)


def _stage(name: str, features: int, **more) -> Stage:
    return Stage(name, SETTINGS[name]["cols"], lambda: estimator(name, features), **more)


def _doubled(df):
    return augment.double_mirror(df, "w", 180.0)


def flows(domain: int, features: int = 1024) -> list[Flow]:
    """Stages of a domain; domain 4 has none, all of it is the region."""
    if domain == 1:
        linear = Stage("1-atira-aten", ["a", "i"], lambda: MarginSVC(kernel="linear"))
        return [
            Flow(("atira", "aten"), [linear]),
            Flow(
                ("apollo",),
                [
                    _stage(
                        "1-apollo", features, augment=[_doubled],
                        train_where=lambda: F.col("q") > 0.7,
                    ),
                    _stage("1-apollo-rest", features, augment=[_doubled]),
                ],
            ),
            Flow(
                ("amor",),
                [
                    _stage(
                        "1-amor", features, follow="inside",
                        augment=[_doubled, lambda df: _extended_by_class(df, 0.25)],
                    ),
                    _stage(
                        "1-amor-inside", features, augment=[lambda df: augment.mirror(df, "w", 180.0)]
                    ),
                ],
            ),
        ]
    if domain == 2:
        side = lambda: filters.side_of_line(*DOMAIN_2_LINE, "a", "q") == "left"
        return [
            Flow(
                ("atira", "aten"),
                [
                    _stage("2-atira-aten", features, where=side, augment=[_doubled]),
                    _stage("2-atira-aten-rest", features, where=lambda: F.col("q") > 0.5),
                ],
            ),
            Flow(
                ("apollo",),
                [
                    _stage("2-apollo", features, augment=[_doubled]),
                    _stage("2-apollo-rest", features, augment=[_doubled]),
                    _stage("2-apollo-4d", features, counts=False),
                ],
            ),
        ]
    if domain == 3:
        return [
            Flow(("atira", "aten"), [_stage("3-atira-aten", features, augment=[_doubled])]),
            Flow(("apollo",), [_stage("3-apollo", features, augment=[_doubled])]),
        ]
    return []


def _extended_by_class(df, factor):
    """The classes are extended one by one, each by its own range."""
    parts = [augment.extend_copies(df.filter(F.col("label") == k), "w", factor) for k in (1, 0)]
    return parts[0].unionByName(parts[1])


def _within(domain: int):
    return F.coalesce(F.col("q") <= DOMAIN_1_Q_LIMIT, F.lit(False)) if domain == 1 else F.lit(True)


def prepared(df, domain: int):
    """Rows of a domain as its stages expect them."""
    return df.filter(_within(domain))


def set_aside(df, domain: int):
    """Rows of a domain that no stage sees, as the cascade leaves rows behind: in no group, not
    extracted, one row each. They count in the totals of the domain and of the origin."""
    none = F.lit(None).cast("string")
    return df.filter(~_within(domain)).withColumns(
        {"grp": none, "first_tag": F.lit(True), "stage": none, "extracted": F.lit(False)}
    )

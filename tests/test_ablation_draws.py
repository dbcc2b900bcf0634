import pytest

from ledgerspark.catalog import evaluation as E


class Reached(Exception):
    pass


def test_ablation_verdict_takes_the_reference_number_of_draws(spark, sf_dir, monkeypatch):
    def metrics(*args, n_boot):
        raise Reached(n_boot)

    monkeypatch.setattr(E.S, "ablation_metrics", metrics)
    with pytest.raises(Reached) as found:
        E.ablation_verdict(spark, sf_dir)
    assert found.value.args == (150,)

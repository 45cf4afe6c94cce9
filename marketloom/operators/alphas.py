"""Formulaic alphas over the dense panel: name -> stages of expressions, the last named alpha."""

from __future__ import annotations

from marketloom.functions.windows import decay_linear, delay, delta, rolling_corr, rolling_cov, signed_power, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum, xrank
from marketloom.plans.rel import Rel

STAGES: dict[str, list[dict[str, str]]] = {
    "reversal_returns": [{"alpha": ts_sum("ret", 5)}],
    "a3_open_volume": [{"ro": xrank("open"), "rv": xrank("volume")}, {"alpha": f"-({rolling_corr('ro', 'rv', 10)})"}],
    "a2_volume_change": [
        {"lv": "CASE WHEN volume > 0 THEN ln(volume) END", "x": "(close - open) / nullif(open, 0.0)"}, {"dv": f"round({delta('lv', 2)}, 10)", "xr": "round(x, 10)"},
        {"rv": xrank("dv"), "rx": xrank("xr")}, {"alpha": f"-({rolling_corr('rv', 'rx', 6)})"}],
    "a6_open_volume": [{"alpha": f"-({rolling_corr('open', 'volume', 10)})"}],
    "a13_close_volume": [{"rc": xrank("close"), "rv": xrank("volume")}, {"alpha": f"-({rolling_cov('rc', 'rv', 5)})"}],
    "a16_high_volume": [{"rh": xrank("high"), "rv": xrank("volume")}, {"alpha": f"-({rolling_cov('rh', 'rv', 5)})"}],
    "a12_volume_sign": [{"alpha": f"sign({delta('volume', 1)}) * (-{delta('close', 1)})"}],
    "decay_momentum": [{"alpha": decay_linear("ret", 10)}],
    "a8_open_return": [{"so": ts_sum("open", 5), "sr": ts_sum("ret", 5)}, {"p": "so * sr"}, {"alpha": f"-{delta('p', 10)}"}],
    "a53_close_place": [{"place": "((close - low) - (high - close)) / nullif(close - low, 0.0)"}, {"alpha": f"-{delta('place', 9)}"}],
    "a54_low_close": [{"alpha": "-((low - close) * pow(open, 5)) / nullif((low - high) * pow(close, 5), 0.0)"}],
    "bar_close_place": [{"alpha": "CASE WHEN high > low THEN (close - low) / (high - low) END"}],
    "a101_body": [{"alpha": "(close - open) / ((high - low) + 0.001)"}],
    "a22_corr_change": [{"c": rolling_corr("high", "volume", 5), "s": f"round({ts_std('close', 20)}, 10)"}, {"dc": delta("c", 5), "rs": xrank("s")}, {"alpha": "-(dc * rs)"}],
    "a40_std_corr": [{"s": f"round({ts_std('high', 10)}, 10)", "c": rolling_corr("high", "volume", 10)}, {"rs": xrank("s")}, {"alpha": "-rs * c"}],
    "return_deviation": [{"alpha": ts_std("ret", 20)}],
    "a20_open_gaps": [
        {"gh": f"open - {delay('high', 1)}", "gc": f"open - {delay('close', 1)}", "gl": f"open - {delay('low', 1)}"}, {"xh": "round(gh, 9)", "xc": "round(gc, 9)", "xl": "round(gl, 9)"},
        {"rh": xrank("xh"), "rc": xrank("xc"), "rl": xrank("xl")}, {"alpha": "-(rh * rc * rl)"}],
    "signed_power_return": [{"s": ts_sum("ret", 5)}, {"alpha": f"-{signed_power('s', 2.0)}"}],
    "a4_low_rank": [{"rl": xrank("low")}, {"alpha": f"-({ts_rank('rl', 9)})"}],
    "a9_trend_change": [{"dc": delta("close", 1)}, {"lo": ts_min("dc", 5), "hi": ts_max("dc", 5)}, {"alpha": "CASE WHEN lo > 0 THEN dc WHEN hi < 0 THEN dc ELSE -dc END"}],
    "vwap_deviation": [{"m": ts_mean("vwap", 5)}, {"alpha": "(close - m) / nullif(close, 0.0)"}],
}


def alpha(panel: Rel, name: str) -> Rel:
    """(symbol, ts, alpha) of a named formula."""
    for stage in STAGES[name]:
        panel = panel.with_(**stage)
    return panel.select("symbol", "ts", "alpha")

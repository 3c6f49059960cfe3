"""Fixed values. Results depend on each of them, so they are stated here as plain data."""

# Small term added to denominators, and the bound below which a guarded division is unknown.
EPS = 1e-12

# Outcome regimes: horizon in bars, target return over entry, floor as a share of entry.
REGIMES = {
    "webpro": (10, 0.30, 0.80),
    "low60": (60, 3.0, 0.80),
    "low504": (504, 3.0, 0.80),
}

# Scan grid.
MIN_HISTORY = 60
STRIDE = 5
CARD_BARS = 60
COOLDOWN = 60

# Normal quantiles of the two interval conventions.
Z_EXACT = 1.959963984540054
Z_SHORT = 1.96

# Round-trip cost in basis points.
COST_BPS = 10.2

# Daily price limits by board prefix, and the tolerance below the limit.
LIMIT_MAIN = 0.10
LIMIT_WIDE = 0.20
WIDE_PREFIXES = ("300", "688", "301")
LIMIT_TOLERANCE = 0.005

# Rule strategies: cutoff and the weight of each component, in component order.
STRATEGIES = {
    "leader_momentum": (0.90, {
        "recent_near_limit_returns": 0.30, "close_location": 0.20, "momentum_persistence": 0.20,
        "turnover": 0.15, "volume_support": 0.15}),
    "first_board_breakout": (0.90, {
        "no_recent_near_limit": 0.30, "fresh_prior_20_high": 0.30, "close_strength": 0.20,
        "controlled_volume_expansion": 0.20}),
    "reversal_engulf": (0.82, {
        "prior_impulse": 0.22, "pullback": 0.16, "body_recovery": 0.20, "high_reclaim": 0.17,
        "lower_wick": 0.10, "volume_confirmation": 0.15}),
    "washout_complete": (0.82, {
        "rising_structure": 0.24, "shrinking_volume_pullback": 0.20, "support_hold": 0.20,
        "kdj_turn": 0.16, "renewed_close_strength": 0.20}),
    "accumulation_base": (0.90, {
        "range_compression": 0.25, "positive_negative_volume_asymmetry": 0.25,
        "stable_turnover": 0.25, "improving_close_location": 0.25}),
    "platform_breakout": (0.80, {
        "volatility_squeeze": 0.25, "breakout_20_40": 0.25, "volume_ratio_expansion": 0.25,
        "limited_prior_extension": 0.25}),
    "main_wave_acceleration": (0.85, {
        "aligned_multi_horizon_returns": 0.25, "positive_slopes": 0.20, "higher_highs_lows": 0.20,
        "recent_acceleration": 0.20, "overextension_penalty": 0.15}),
    "oversold_rebound": (0.82, {
        "deep_drawdown": 0.18, "low_range_percentile": 0.14, "selling_exhaustion": 0.16,
        "kdj_oversold_turn": 0.20, "lower_wick": 0.12, "reversal_close": 0.20}),
    "turnover_weak_to_strong": (0.90, {
        "prior_weakness": 0.20, "high_turnover_recovery": 0.20, "close_location": 0.20,
        "broad_range": 0.20, "volume_ratio_confirmation": 0.20}),
    "high_level_consensus": (0.80, {
        "preceding_trend": 0.25, "controlled_short_disagreement": 0.25, "renewed_strength": 0.25,
        "strict_failure_risk_filters": 0.25}),
    "donchian_turtle": (0.72, {
        "channel_breakout": 0.35, "trend_filter": 0.25, "volume_confirmation": 0.20,
        "atr_tradeability": 0.20}),
    "bollinger_squeeze": (0.70, {
        "squeeze": 0.25, "band_release": 0.30, "volatility_expansion": 0.20,
        "volume_confirmation": 0.15, "close_strength": 0.10}),
    "rsi_mean_reversion": (0.68, {
        "rsi_oversold": 0.30, "drawdown": 0.25, "rejection": 0.20, "kdj_turn": 0.15,
        "nonpanic_volume": 0.10}),
    "gap_follow_through": (0.72, {
        "gap_quality": 0.30, "close_strength": 0.25, "volume_confirmation": 0.20,
        "range_acceptance": 0.15, "rejection_control": 0.10}),
    "pullback_retest": (0.70, {
        "prior_impulse": 0.25, "shallow_pullback": 0.25, "level_hold": 0.25, "volume_dryup": 0.15,
        "close_stability": 0.10}),
    "obv_volume_price": (0.70, {
        "price_slope": 0.25, "obv_slope": 0.30, "up_volume_share": 0.20,
        "volume_confirmation": 0.15, "close_strength": 0.10}),
    "turnover_regime_switch": (0.62, {
        "high_turnover_momentum": 0.35, "low_turnover_reversal": 0.30, "kdj_recovery": 0.20,
        "regime_clarity": 0.15}),
    "relative_strength_rank": (0.72, {
        "five_day_strength": 0.30, "twenty_day_strength": 0.25, "forty_day_strength": 0.20,
        "trend_alignment": 0.15, "close_strength": 0.10}),
    "atr_trend_follow": (0.72, {
        "channel_position": 0.30, "trend_slope": 0.25, "atr_regime": 0.20, "close_strength": 0.15,
        "stop_room": 0.10}),
    "limit_up_retest": (0.70, {
        "limit_event": 0.30, "post_event_hold": 0.25, "follow_through": 0.20,
        "volume_support": 0.15, "close_quality": 0.10}),
}

# Threshold selectors: base strategy and the selector's own cutoff.
SELECTORS = {
    "strict_accumulation_base_v2": ("accumulation_base", 0.462083),
    "strict_bollinger_release_v2": ("bollinger_squeeze", 0.952088),
    "strict_first_board_breakout_v2": ("first_board_breakout", 0.7),
    "strict_gap_follow_through": ("gap_follow_through", 0.75),
    "strict_gap_follow_through_v2": ("gap_follow_through", 0.690867),
    "strict_leader_momentum_v2": ("leader_momentum", 0.788535),
    "strict_obv_volume_price": ("obv_volume_price", 0.97),
    "strict_obv_volume_price_v2": ("obv_volume_price", 0.969655),
    "strict_oversold_rebound_v2": ("oversold_rebound", 0.449606),
    "strict_platform_breakout": ("platform_breakout", 0.65),
    "strict_platform_breakout_v2": ("platform_breakout", 0.607503),
    "strict_relative_strength": ("relative_strength_rank", 0.96),
    "strict_relative_strength_v2": ("relative_strength_rank", 0.95137),
    "strict_turnover_weak_to_strong_v2": ("turnover_weak_to_strong", 0.70274),
    "strict_washout_complete": ("washout_complete", 0.72),
    "strict_washout_complete_v2": ("washout_complete", 0.703662),
}

# Low-zone versions: name, lowest tier, model kind, per-year threshold, first signal per year.
LOWZONE_VERSIONS = (
    ("V00", 1, "rule", False, False),
    ("V01", 3, "rule", False, False),
    ("V02", 5, "rule", False, False),
    ("V03", 1, "gain", False, False),
    ("V06", 3, "competitive", False, False),
    ("V07", 3, "competitive", True, False),
    ("V08", 3, "competitive", True, True),
)

# Matrix feature groups.
FEATURE_GROUPS = {
    "momentum": (
        "ret1", "ret2", "ret3", "ret5", "ret10", "ret20", "ret60", "ret120", "ret250",
        "dist_ma5", "ma5_slope", "dist_ma10", "ma10_slope", "dist_ma20", "ma20_slope",
        "dist_ma60", "ma60_slope", "dist_ma120", "ma120_slope", "dist_ma250", "ma250_slope"),
    "volatility": (
        "vol5", "vol10", "vol20", "vol60", "atr14_pct", "range_5_20", "range_20_60", "range_pct"),
    "volume": (
        "vol_ma5", "vol_ma20", "vol_ma60", "vol_ratio_1_5", "vol_ratio_5_20", "vol_ratio_20_60",
        "vol_stability_20"),
    "limitup": ("limitup_5", "limitup_10", "limitup_20", "limitup_yesterday", "up_rate_20"),
    "position": (
        "pos_60", "dd_60", "to_high_60", "pos_120", "dd_120", "to_high_120", "pos_250", "dd_250",
        "to_high_250"),
    "candle": ("close_loc", "upper_wick", "lower_wick", "body_pct", "gap_open"),
    "kdj": ("kdj_k", "kdj_d", "kdj_j", "kdj_k_chg5", "kdj_j_chg5", "kdj_k_minus_d"),
    "market": (
        "mkt_ret1", "mkt_breadth", "mkt_dispersion", "mkt_ret5", "mkt_ret20", "mkt_ret60",
        "mkt_vol20", "beta_60", "resid_ret1"),
    "cross": (
        "cs_ret5_rank", "cs_ret5_z", "cs_ret20_rank", "cs_ret20_z", "cs_ret60_rank", "cs_ret60_z",
        "cs_volratio_rank", "cs_volratio_z", "cs_atr_rank", "cs_atr_z", "cs_pos60_rank",
        "cs_pos60_z"),
}

# Columns of the matrix that are keys or labels, never features.
META_COLUMNS = (
    "code", "date", "entry_open", "fwd_max_high", "fwd_min_low", "label_high", "resolved",
    "fwd_max_close", "label_close")

# Cross-sectional source column of each ranked feature.
CROSS_SOURCES = {
    "cs_ret5": "ret5", "cs_ret20": "ret20", "cs_ret60": "ret60",
    "cs_volratio": "vol_ratio_5_20", "cs_atr": "atr14_pct", "cs_pos60": "pos_60"}

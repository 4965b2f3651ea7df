"""The normal distribution in SQL, for engines without erfc: text that Spark and DuckDB read alike."""

from __future__ import annotations

# The coefficients of Cody's rational fits to erf and erfc on three ranges, the highest power first, and of Acklam's inverse.
ERF_UP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DOWN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_UP = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3,
    1.23033935479799725e3,
)
MID_DOWN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_UP = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_DOWN = (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(x: str, coefficients) -> str:
    """Horner's scheme, the highest power first. Numbers are written as doubles."""
    out = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def erfc(x: str) -> str:
    """erfc of the SQL expression ``x``, to some 15 digits."""
    y, square = f"abs({x})", f"(({x}) * ({x}))"
    inverse = f"(1e0 / {square})"
    near = f"(1 - ({x}) * {_poly(square, ERF_UP)} / {_poly(square, ERF_DOWN)})"
    mid = f"(exp(-{square}) * {_poly(y, MID_UP)} / {_poly(y, MID_DOWN)})"
    far = f"(exp(-{square}) / {y} * (0.56418958354775628695e0 - {inverse} * {_poly(inverse, FAR_UP)} / {_poly(inverse, FAR_DOWN)}))"
    tail = f"CASE WHEN {y} <= 4 THEN {mid} ELSE {far} END"
    return f"CASE WHEN {y} <= 0.46875e0 THEN {near} WHEN ({x}) > 0 THEN {tail} ELSE 2 - ({tail}) END"


def two_sided_p(z: str) -> str:
    """Probability of a normal value at least as far from zero as ``z``."""
    return erfc(f"(abs({z}) / sqrt(2e0))")


def upper_p(z: str) -> str:
    """Probability of a normal value above ``z``."""
    return f"0.5e0 * ({erfc(f'(({z}) / sqrt(2e0))')})"


def quantile(p: str) -> str:
    """The normal value below which a share ``p`` lies, with a relative error below 1.2e-9; null outside (0, 1)."""
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    mid = f"((({p}) - 0.5e0) * (({p}) - 0.5e0))"
    return (
        f"CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.02425e0 THEN {_poly(low, C)} / {_poly(low, D)}"
        f" WHEN ({p}) > 0.97575e0 THEN -{_poly(high, C)} / {_poly(high, D)} ELSE (({p}) - 0.5e0) * {_poly(mid, A)} / {_poly(mid, B)} END"
    )


def expected_maximum(n: str) -> str:
    """Bailey and Lopez de Prado's expected maximum of ``n`` independent normal values, in deviations; 0 for n up to 1."""
    gamma, e = "0.5772156649015329e0", "2.718281828459045e0"
    return f"CASE WHEN ({n}) <= 1 THEN 0e0 ELSE (1 - {gamma}) * ({quantile(f'(1 - 1e0 / ({n}))')}) + {gamma} * ({quantile(f'(1 - 1e0 / (({n}) * {e}))')}) END"

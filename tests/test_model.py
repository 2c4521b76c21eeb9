
import numpy as np
import pytest

from perioda.model.data import Data, evaluate_expression
from perioda.model.estimate import chow_test, estimate, estimate_equation, from_moments, moments
from perioda.model.expr import MdlSyntaxError, Number, Variable, numeric, offsets, parse_expression, temporal_offsets, variable_names
from perioda.model.parse import Model, load_model, parse_mdl
from perioda.model.probability import f_survival, t_two_sided
from perioda.model.rng import RStream
from perioda.model.simulate import Bound, Disturbance, MultiplierError, RenormalizationError, Timed, bind_model_data, multiplier_matrix, optimize_model, renormalize, simulate, stochastic_simulate
from perioda.model.solve import ConvergenceError, blocks

ROWS = """39.8,4.6,2.7,182.8,12.7,28.8,43.7,3.4,NA,2.2
41.9,6.6,-0.2,182.6,12.4,25.5,40.6,7.7,-10,2.7
45,6.1,1.9,184.5,16.9,29.3,49.1,3.9,-9,2.9
49.2,5.7,5.2,189.7,18.4,34.1,55.4,4.7,-8,2.9
50.6,6.6,3,192.7,19.4,33.9,56.4,3.8,-7,3.1
52.6,6.5,5.1,197.8,20.1,35.4,58.7,5.5,-6,3.2
55.1,6.6,5.6,203.4,19.6,37.4,60.3,7,-5,3.3
56.2,7.6,4.2,207.6,19.8,37.9,61.3,6.7,-4,3.6
57.3,7.9,3,210.6,21.1,39.2,64,4.2,-3,3.7
57.8,8.1,5.1,215.7,21.7,41.3,67,4,-2,4
55,9.4,1,216.7,15.6,37.9,57.7,7.7,-1,4.2
50.9,10.7,-3.4,213.3,11.4,34.5,50.7,7.5,0,4.8
45.6,10.2,-6.2,207.1,7,29,41.3,8.3,1,5.3
46.5,9.3,-5.1,202,11.2,28.5,45.3,5.4,2,5.6
48.7,10,-3,199,12.3,30.6,48.9,6.8,3,6
51.3,10.5,-1.3,197.7,14,33.2,53.3,7.2,4,6.1
57.7,10.3,2.1,199.8,17.6,36.8,61.8,8.3,5,7.4
58.7,11,2,201.8,17.3,41,65,6.7,6,6.7
57.5,13,-1.9,199.9,15.3,38.2,61.2,7.4,7,7.7
61.6,14.4,1.3,201.2,19,41.6,68.4,8.9,8,7.8
65,15.4,3.3,204.5,21.1,45,74.1,9.6,9,8
69.7,22.3,4.9,209.4,23.5,53.3,85.3,11.6,10,8.5"""
NAMES = "cn,g,i,k,p,w1,y,t,time,w2".split(",")
TABLE = {n: ((1920, 1), [None if r.split(",")[j] == "NA" else float(r.split(",")[j]) for r in ROWS.splitlines()]) for j, n in enumerate(NAMES)}
CN = "BEHAVIORAL> cn\nTSRANGE {a} 1 1941 1\nEQ> cn = a1 + a2*p + a3*TSLAG(p,1) + a4*(w1+w2)\nCOEFF> a1 a2 a3 a4\n"
I = "BEHAVIORAL> i\nTSRANGE {a} 1 1941 1\nEQ> i = b1 + b2*p + b3*TSLAG(p,1) + b4*TSLAG(k,1)\nCOEFF> b1 b2 b3 b4\n"  # noqa: E741
W1 = "BEHAVIORAL> w1\nTSRANGE {a} 1 1941 1\nEQ> w1 = c1 + c2*(y+t-w2) + c3*TSLAG(y+t-w2,1) + c4*time\nCOEFF> c1 c2 c3 c4\n"
REST = "IDENTITY> y\nEQ> y = cn + i + g - t\nIDENTITY> p\nEQ> p = y - (w1+w2)\nIDENTITY> k\nEQ> k = TSLAG(k,1) + i\n"
KLEIN = f"MODEL\n{CN.format(a=1921)}{I.format(a=1921)}{W1.format(a=1921)}{REST}END"
ADVANCED = f"MODEL\n{CN.format(a=1925)}ERROR> AUTO(2)\n{I.format(a=1923)}RESTRICT> b2 + b3 = 1\n{W1.format(a=1925)}PDL> c3 1 3\n{REST}END"
LEAD = f"MODEL\n{CN.format(a=1921)}IDENTITY> i\nEQ> i = (MOVAVG(i,2)+TSLEAD(i))/2\n{W1.format(a=1921)}{REST}END"


@pytest.fixture(scope="module")
def data():
    return Data.of(TABLE, 1)


@pytest.fixture(scope="module")
def klein(data):
    m = load_model(model_text=KLEIN)
    return m, estimate(m, data)


def extended(until, linear=("t", "k", "time"), constant=("w2", "g")):
    out = {}
    for n, (s, v) in TABLE.items():
        v, k = list(v), until - 1941
        v += [v[-1]] * k if n in constant else [v[-1] + (v[-1] - v[-2]) * (j + 1) for j in range(k)] if n in linear else []
        out[n] = (s, v)
    return Data.of(out, 1)


# ---- language


def test_expressions():
    e = parse_expression("-a^b + 2*LAG(x+TSLAG(y,2)) .GE. 1.5e1 & z>1")
    assert variable_names(e) == {"a", "b", "x", "y", "z"} and offsets(e)["y"] == {-3}
    assert temporal_offsets(parse_expression("MOVAVG(x,3)+LEAD(y,2)")) == (2, 2)
    assert numeric(parse_expression("-2^2")) == -4 and numeric(parse_expression("2^3^2")) == 512 and numeric(parse_expression("-2*3")) == -6
    assert parse_expression("PI").value == pytest.approx(3.14159265) and isinstance(parse_expression("1."), Number) and parse_expression("x") == Variable("x")
    for bad in ("", "x+", "LOG", "FOO(x)", "LAG(x,-1)", "LAG(x,1.5)", "DEL(x,0)", "LOG(x,2)", "(x", "x y", "x $ y"):
        with pytest.raises(MdlSyntaxError):
            parse_expression(bad)


def test_evaluation(data):
    t, v = evaluate_expression(parse_expression("TSLAG(cn,2) + g"), data)
    assert t == 1922 and v[0] == 39.8 + 6.1 and len(v) == 20
    assert evaluate_expression(parse_expression("2*3"), data) == 6.0
    with pytest.raises(KeyError):
        evaluate_expression(parse_expression("nobody"), data)


BAD = [
    "IDENTITY> y\nEQ> y = x", "MODEL\nIDENTITY> y\nEQ> y = x", "MODEL\nEND", "MODEL\nEQ> y = x\nEND", "MODEL\nIDENTITY> y\nEND", "MODEL\nIDENTITY> y\nEQ> z = x\nEND", "MODEL\nIDENTITY> y\nEQ> y = x $ no\nEND",
    "MODEL\nFOO> y\nEND", "MODEL\nIDENTITY> y\nEQ> y = x\nCOEFF> a\nEND", "MODEL\nIDENTITY> y\nEQ> y = x\nIF> 3\nEND", "MODEL\nIDENTITY> LOG\nEQ> LOG = x\nEND", "MODEL\nIDENTITY> a__b\nEQ> a__b = x\nEND",
    "MODEL\nBEHAVIORAL> y\nEQ> y = a*x\nEND", "MODEL\nBEHAVIORAL> y\nCOEFF> a\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> b a\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a*a*x\nCOEFF> a\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = x*a\nCOEFF> a\nEND",
    "MODEL\nBEHAVIORAL> y\nEQ> y = a + b\nCOEFF> a b\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> a b\nERROR> AUTO(0)\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> a b\nPDL> b 3 3\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> a b\nPDL> a 1 3\nEND",
    "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> a b\nRESTRICT> a + a = 1\nEND", "MODEL\nBEHAVIORAL> y\nEQ> y = a + b*x\nCOEFF> a b\nRESTRICT> a + c = 1\nEND", "MODEL\nBEHAVIORAL> y\nTSRANGE 2000 1 2001\nEQ> y = a*x\nCOEFF> a\nEND", "MODEL\nIDENTITY> y\nEQ> y = x\nIDENTITY> y\nEQ> y = z\nEND",
    "MODEL\nIDENTITY> y\nEQ> LOG(y) = x\nIF> x > 1\nIDENTITY> y\nEQ> y = z\nIF> x < 1\nEND", "MODEL\nIDENTITY> y\nEQ> ABS(y) = x\nEND",
]


@pytest.mark.parametrize("text", BAD)
def test_bad_documents(text):
    with pytest.raises(MdlSyntaxError):
        parse_mdl(text)


def test_model_facts(klein):
    m, _ = klein
    assert m.exogenous == ("g", "t", "time", "w2") and (m.max_lag, m.max_lead) == (1, 0)
    b = blocks(m)
    assert [(x.variables, x.simultaneous, x.feedback) for x in b] == [(("w1", "p", "cn", "i", "y"), True, ("y",)), (("k",), False, ())]
    assert Model.from_text(KLEIN).endogenous == ("cn", "i", "w1", "y", "p", "k")
    assert load_model(model_text=LEAD).max_lead == 1
    text = "MODEL\n$ note\nCOMMENT> more\nbehavioral > y TSRANGE 2000 1 2001 4\neq> LOG(y,1) = a\n + b*x\ncoeff> a b\nstore> c(1)\niv> x\nEND"
    with pytest.raises(MdlSyntaxError):
        parse_mdl(text)  # LOG has one argument
    got = parse_mdl(text.replace("LOG(y,1)", "TSDELTA(y,2)"))
    assert got.behaviorals["y"].equation.periods == 2 and got.max_lag == 2 and got.behaviorals["y"].time_range.end == (2001, 4)


# ---- estimation


def test_least_squares(klein):
    e = klein[1]["cn"]
    assert list(e.coefficients.values()) == pytest.approx([16.2366003, 0.1929344, 0.0898849, 0.7962187], abs=5e-8)
    assert (e.ssr, e.standard_error, e.r_squared, e.adjusted_r_squared, e.log_likelihood, e.dof) == pytest.approx((17.87945, 1.02554, 0.9810082, 0.9776567, -28.10857, 17), rel=1e-6)


def test_autoregression_restriction_lags(data):
    e = estimate(load_model(model_text=ADVANCED), data)
    cn, i, w1 = e["cn"], e["i"], e["w1"]
    assert list(cn.coefficients.values()) == pytest.approx([19.01352476, 0.34428157, 0.03443117, 0.69939052], abs=5e-8)
    assert list(cn.rho) == pytest.approx([0.057431312, 0.007785936], abs=5e-9) and cn.iterations == 9
    assert (cn.durbin_watson, cn.f_statistic, cn.aic, cn.bic) == pytest.approx((1.966609, 147.0844, 51.94093, 57.77343), rel=1e-6)
    assert list(i.coefficients.values()) == pytest.approx([2.868104, 0.5787626, 0.4212374, -0.09160307], rel=1e-6)
    assert (i.restriction_f, i.restriction_probability) == pytest.approx((8.194478, 0.0118602), rel=1e-5)
    assert list(w1.coefficients.values()) == pytest.approx([1.12869024, 0.43987666, 0.10768118, 0.05074557, -0.00619005, 0.13682057], abs=5e-8)
    assert {"RHO_1", "RHO_2"} <= set(cn.summary()["coefficient"])


def test_end_conditions(data):
    m = parse_mdl("MODEL\nBEHAVIORAL> cn\nEQ> cn = a + b*y\nCOEFF> a b\nPDL> b 2 4 N F\nRESTRICT> LAG(b,2) = 0\nEND")
    e = estimate(m, data, time_range=((1924, 1), (1941, 1)))["cn"]
    assert [v for k, v in e.coefficients.items() if k.startswith("b__PDL__")] == pytest.approx([0, 0, 0, 0], abs=1e-9)


def test_chow(klein, data):
    m, e = klein
    c = chow_test(load_model(model_text=KLEIN.replace("TSRANGE 1921 1 1941 1", "TSRANGE 1921 1 1935 1")).behaviorals["cn"], data, estimate_equation(load_model(model_text=KLEIN.replace("TSRANGE 1921 1 1941 1", "TSRANGE 1921 1 1935 1")).behaviorals["cn"], data), (1941, 1))
    assert (c.f_statistic, c.f_probability) == pytest.approx((4.488731, 0.006687229), rel=1e-6)
    assert len(c.summary()) == 6


def test_instruments(data):
    m = parse_mdl(f"MODEL\n{CN.format(a=1921)}IV> 1\nIV> TSLAG(y)\nIV> TSLAG(w1)\nIV> w2\nEND")
    e = estimate(m, data, method="IV")["cn"]
    lo, hi = 1921 - 1920, 22
    col = lambda n, k=0: np.array(TABLE[n][1], dtype=float)[lo - k : hi - k]
    x = np.column_stack([np.ones(21), col("p"), col("p", 1), col("w1") + col("w2")])
    z = np.column_stack([np.ones(21), col("y", 1), col("w1", 1), col("w2")])
    assert list(e.beta) == pytest.approx(list(np.linalg.solve(z.T @ x, z.T @ col("cn"))), rel=1e-6)
    with pytest.raises(ValueError, match="instruments"):
        estimate(parse_mdl("MODEL\nBEHAVIORAL> cn\nEQ> cn = a + b*p\nCOEFF> a b\nEND"), data, method="IV")


def test_estimation_faults(data):
    with pytest.raises(ValueError, match="depend"):
        estimate(parse_mdl("MODEL\nBEHAVIORAL> cn\nEQ> cn = a*p + b*(2*p)\nCOEFF> a b\nEND"), data)
    with pytest.raises(ValueError, match="missing"):
        estimate(parse_mdl("MODEL\nBEHAVIORAL> cn\nEQ> cn = a + b*time\nCOEFF> a b\nEND"), data)


def test_moments(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(1 + 2 * a - b)) for a, b in rng.normal(size=(200, 2))] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = moments(df, "y", ["a", "b"])
    got = from_moments(m, "y", ["a", "b"])
    assert m["1", "1"] == 200 and [got[k] for k in ("1", "a", "b")] == pytest.approx([1, 2, -1])


def test_probabilities():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6) and f_survival(3.0, 2, 10) == pytest.approx(0.09536743, rel=1e-6)
    assert f_survival(0, 1, 1) == 1.0 and f_survival(float("inf"), 1, 1) == 0.0


# ---- simulation


def test_dynamic(klein, data):
    m, e = klein
    s = simulate(m, data, ((1923, 1), (1941, 1)), coefficients=e, convergence=1e-5)
    assert s["cn"][[0, 1, 2, -2, -1]] == pytest.approx([50.338, 55.6994, 56.7111, 66.7799, 75.451], abs=5e-5)
    assert s["y"][[0, 1, 2, -2, -1]] == pytest.approx([56.0305, 65.8526, 64.265, 76.8049, 93.4459], abs=6e-5)
    for a in ("NEWTON", "FULLNEWTON"):
        n = simulate(m, data, ((1923, 1), (1941, 1)), coefficients=e, convergence=1e-7, algorithm=a)
        assert n["y"] == pytest.approx(s["y"], abs=1e-3)
    assert len(s.summary()) == 6 * 19 and s.iterations[1923, 1] > 1
    back = simulate(m, data, ((1925, 1), (1926, 1)), coefficients=e, backfill=3)
    assert back.start == (1922, 1) and back["cn"][:3] == pytest.approx([45, 49.2, 50.6])


def test_forecast(klein):
    m, e = klein
    d = extended(1944, ("time",), ("w2", "t", "g"))
    assert simulate(m, d, ((1941, 1), (1944, 1)), coefficients=e, convergence=1e-5, kind="FORECAST")["y"] == pytest.approx([95.41613, 106.8923, 107.4302, 100.7512], abs=5e-5)


def test_residual_check(klein, data):
    m, e = klein
    r = simulate(m, data, ((1923, 1), (1941, 1)), coefficients=e, kind="RESCHECK")
    factors = {n: ((1923, 1), list(r.add_factors(n))) for n in m.endogenous}
    s = simulate(m, data, ((1923, 1), (1941, 1)), coefficients=e, adjust=factors, convergence=1e-9, max_iterations=1000)
    assert s["y"] == pytest.approx(np.array(TABLE["y"][1][3:], dtype=float), abs=1e-6)


@pytest.mark.parametrize("algorithm,tol", [("GAUSS-SEIDEL", 5e-6), ("NEWTON", 2e-3)])
def test_forward_looking(algorithm, tol):
    m, table = load_model(model_text=LEAD), dict(TABLE)
    v = list(TABLE["i"][1])
    v[11] = 2.0
    table["i"] = ((1920, 1), v)
    d = Data.of(table, 1)
    s = simulate(m, d, ((1924, 1), (1930, 1)), coefficients=estimate(m, d), algorithm=algorithm)
    assert s["i"] == pytest.approx([3.594946, 2.792062, 2.390277, 2.189125, 2.08838, 2.037915, 2.012644], abs=tol)


def test_transformed_left_sides():
    d = Data.of({n: ((2000, 1), v) for n, v in {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0, 3.0], "c": [1.0, 2.0, 3.0], "d": [1.0, 2.0, 3.0], "e": [1.0, 2.0, 3.0], "x": [0.1, 0.2, 0.3]}.items()}, 1)
    m = parse_mdl("MODEL\n" + "".join(f"IDENTITY> {n}\nEQ> {f}({n}) = x\n" for n, f in zip("abcde", ("LOG", "EXP", "TSDELTA", "TSDELTALOG", "TSDELTAP"))) + "END")
    with pytest.raises(ValueError):
        simulate(m, d, ((1999, 1), (2000, 1)))
    s = simulate(m, Data.of({n: ((2000, 1), list(d.arrays[n] + 1 if n == "x" else d.arrays[n])) for n in d.arrays}, 1), ((2001, 1), (2002, 1)))
    assert s["a"] == pytest.approx(np.exp([1.2, 1.3])) and s["b"] == pytest.approx(np.log([1.2, 1.3])) and s["c"] == pytest.approx([2.2, 3.5]) and s["d"] == pytest.approx(np.exp([1.2, 2.5])) and s["e"] == pytest.approx([1.012, 1.012 * 1.013])


def test_no_convergence():
    m = parse_mdl("MODEL\nIDENTITY> a\nEQ> a = 2*b + x\nIDENTITY> b\nEQ> b = a + 1\nEND")
    d = Data.of({n: ((2000, 1), [1.0, 1.0]) for n in "abx"}, 1)
    with pytest.raises(ConvergenceError):
        simulate(m, d, ((2001, 1), (2001, 1)), max_iterations=5)
    assert simulate(m, d, ((2001, 1), (2001, 1)), algorithm="NEWTON")["a"] == pytest.approx([-3.0])


def test_random_streams():
    assert RStream(1).uniform(0, 1, (2, 2)).ravel("F") == pytest.approx([0.26550866, 0.37212390, 0.57285336, 0.90820779], abs=5e-9)
    r = RStream(123)
    assert r.normal(0, 1, (2, 3)).ravel("F") == pytest.approx([-0.560475647, -0.230177489, 1.558708314, 0.070508391, 0.129287735, 1.715064987], abs=5e-10)
    assert sorted(RStream(9).sample(20, 20)) == list(range(1, 21))


def test_multipliers(klein, data):
    m, e = klein
    x = multiplier_matrix(m, data, ((1941, 1), (1941, 1)), ["cn", "y"], ["w2", "g"], coefficients=e, kind="STATIC", convergence=1e-8, max_iterations=1000)
    assert x.values.ravel() == pytest.approx([0.4544079, 1.677342, 0.2537924, 3.661807], rel=1e-5)
    assert x.row_labels() == ["cn_1", "y_1"] and x.at("y", (1941, 1), "g", (1941, 1)) == pytest.approx(3.661807, rel=1e-5) and x.summary().shape == (2, 2)
    with pytest.raises(MultiplierError):
        multiplier_matrix(m, data, ((1941, 1), (1941, 1)), ["g"], ["w2"], coefficients=e)


def test_targeting(klein, data):
    m, e = klein
    how = {"coefficients": e}
    goals = {"cn": [66, 78], "y": [77, 98]}
    r = renormalize(m, data, ((1940, 1), (1941, 1)), goals, ["w2", "g"], convergence=1e-8, max_iterations=1000, **how)
    assert r.converged and r.instruments["w2"] == pytest.approx([7.404308, 9.327926], abs=5e-6) and r.instruments["g"] == pytest.approx([16.102687, 22.651635], abs=5e-6)
    r = renormalize(m, data, ((1940, 1), (1941, 1)), goals, ["w2", "g"], **how)
    assert r.instruments["w2"] == pytest.approx([7.413331, 9.343600], abs=5e-6) and r.instruments["g"] == pytest.approx([16.1069, 22.65985], abs=5e-5)
    assert renormalize(m, data, ((1940, 1), (1941, 1)), {"cn": [66, 78]}, ["i"], convergence=1e-8, max_iterations=1000, **how).converged
    with pytest.raises(RenormalizationError):
        renormalize(m, data, ((1940, 1), (1941, 1)), goals, ["w2"], **how)




def test_stochastic(klein, data):
    m, e = klein
    b = bind_model_data(m, extended(1944))
    s = b.stochastic_simulate(((1941, 1), (1944, 1)), {"cn": Disturbance("NORMAL", (0, 1.0), ((1942, 1), (1942, 1))), "g": Disturbance("UNIFORM", (-1, 1))}, replicas=50, seed=123, coefficients=e, kind="FORECAST")
    assert s.realizations["y"].shape == (4, 50) and s.instruments["g"][0].std() > 0 and s.instruments["cn"][0].std() == 0
    alone = simulate(m, extended(1944), ((1941, 1), (1944, 1)), coefficients=e, kind="FORECAST", convergence=1e-8, max_iterations=1000)
    assert s.baseline["y"] == pytest.approx(alone["y"], rel=1e-2)
    assert len(s.long()) == 6 * 4 * 51 and list(s.summary().columns) == ["__series", "__t", "mean", "sd"]


def test_control():
    m = parse_mdl("MODEL\nIDENTITY> y\nEQ> y = 2*x\nEND")
    d = Data.of({"y": ((2000, 1), [0.0, 0.0]), "x": ((2000, 1), [0.0, 0.0])}, 1)
    o = optimize_model(m, d, ((2001, 1), (2001, 1)), {"x": Bound(0, 10)}, [Timed("-(y-8)^2")], [Timed("x < 4")], replicas=2000, seed=1)
    assert o.instruments["x"][0] == pytest.approx(4, abs=0.02) and o.instruments["x"][0] < 4 and 0 < o.feasible_count < 2000
    assert np.isfinite([o.opt_fun_max, o.opt_fun_ave, o.opt_fun_sd]).all() and o.summary().shape == (1, 6)
    assert optimize_model(m, d, ((2001, 1), (2001, 1)), {"x": Bound(0, 10)}, [Timed("y")], [Timed("x > 11")], replicas=5, seed=1).best is None
    with pytest.raises(ValueError):
        Bound(2, 1)


def test_model_methods_and_frames(spark):
    from perioda.operators.frame import TsFrame

    m = Model.from_text("MODEL\nIDENTITY> y\nEQ> y = x + 0.5*TSLAG(y)\nEND")
    frame = TsFrame.of(spark, [0, 0, 0, 0], (1999, 1), name="y").combine(TsFrame.of(spark, [1, 1, 1], (2000, 1), name="x"))
    d = Data.of_frame(frame)
    span = ((2000, 1), (2002, 1))
    assert list(m.simulate(d, span)["y"]) == [1.0, 1.5, 1.75] and m.identity("y").name == "y"
    assert m.multiplier_matrix(d, span, ["y"], ["x"]).values[2] == pytest.approx([0.25, 0.5, 1.0])
    assert m.renormalize(d, span, {"y": [2, 3, 4]}, ["x"]).instruments["x"] == pytest.approx([2, 2, 2.5])
    assert m.stochastic_simulate(d, span, {"x": Disturbance("UNIFORM", (0, 1))}, replicas=3, seed=1).realizations["y"].shape == (3, 3)
    assert m.optimize(d, span, {"x": Bound(0, 1)}, [Timed("y")], replicas=20, seed=1).best is not None
    with pytest.raises(KeyError):
        m.bind(Data.of({"y": ((1999, 1), [1.0])}, 1))


def test_banded_solver_equals_dense():
    from perioda.model import solve

    r = np.random.default_rng(1)
    at = np.repeat(np.arange(12), [3, 5, 1, 4, 4, 4, 2, 5, 5, 3, 1, 6])
    n = len(at)
    near = (at[None, :] - at[:, None] <= 2) & (at[:, None] - at[None, :] <= 1)
    rows, columns = np.nonzero(near & ((r.random((n, n)) < 0.7) | np.eye(n, dtype=bool)))
    values, b = r.normal(size=len(rows)) - 6 * (rows == columns), r.normal(size=(n, 3))
    assert np.allclose(solve.Banded(at, rows, columns, values).solve(b), np.linalg.solve(solve.dense(n, rows, columns, values), b))
    two = np.array([0, 0]), np.array([0, 1]), np.array([1, 0]), np.array([2.0, 4.0])  # its pivot block is singular at first sight only
    assert np.allclose(solve.Banded(*two).solve(np.ones((2, 1))), [[0.25], [0.5]])
    swapped = np.array([0, 1]), np.array([0, 1]), np.array([1, 0]), np.array([2.0, 4.0])  # no pivots within periods: solved whole
    assert np.allclose(solve.Banded(*swapped).solve(np.ones((2, 1))), [[0.25], [0.5]])

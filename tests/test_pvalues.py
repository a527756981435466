"""Published table values and closed forms."""

import math

import pytest

from spindle.functions import pvalues as p


@pytest.mark.parametrize("t, df, tail", [(2.228, 10, 0.05), (2.576, 1e9, 0.01), (12.706, 1, 0.05), (0.0, 5, 1.0)])
def test_student(t, df, tail):
    assert p.student_two_sided(t, df) == pytest.approx(tail, abs=2e-5)


@pytest.mark.parametrize("x, df, tail", [(3.841, 1, 0.05), (18.307, 10, 0.05), (49.802, 35, 0.05), (0.0, 4, 1.0)])
def test_chi_square(x, df, tail):
    assert p.chi_square_upper(x, df) == pytest.approx(tail, abs=2e-5)


def test_chi_square_with_two_degrees_is_exponential():
    for x in (0.1, 1.0, 5.0, 50.0, 700.0):
        assert p.chi_square_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert p.chi_square_upper(173_362.0, 35) == 0.0


def test_correlation():
    assert p.correlation_two_sided(0.444, 20) == pytest.approx(0.05, abs=5e-4)
    assert p.correlation_two_sided(1.0, 10) == 0.0
    assert p.correlation_two_sided(0.3, 1) is None


def test_mann_whitney_is_exact_for_small_samples_without_ties():
    # complete separation of 3 and 4 values: 2 of the 35 arrangements
    assert p.mann_whitney_two_sided(12, 3, 4, 0) == (pytest.approx(2 / 35), "exact")
    assert p.mann_whitney_two_sided(23, 5, 5, 0)[0] == pytest.approx(8 / 252)
    assert p.mann_whitney_two_sided(23, 5, 5, 6)[1] == "asymptotic"
    assert p.mann_whitney_two_sided(40, 9, 9, 0)[1] == "asymptotic"
    value, method = p.mann_whitney_two_sided(72, 8, 9, 0)
    assert method == "exact" and value == pytest.approx(2 / math.comb(17, 8))


def test_mann_whitney_normal_approximation():
    value, _ = p.mann_whitney_two_sided(150, 20, 20, 0)
    z = (250 - 200 - 0.5) / math.sqrt(20 * 20 * 41 / 12)
    assert value == pytest.approx(math.erfc(z / math.sqrt(2)))


def counted_tail(u, m, n):
    """P(U >= u) by adding up whole numbers: sums of m parts of at most n."""
    ways = [[0] * (m * n + 1) for _ in range(m + 1)]
    ways[0][0] = 1
    for part in range(n + m):
        for k in range(m, 0, -1):
            for total in range(m * n, part - 1 - (k - 1), -1):
                shift = part - (k - 1)
                if 0 <= shift <= total:
                    ways[k][total] += ways[k - 1][total - shift]
    return sum(ways[m][u:]) / math.comb(m + n, m)


@pytest.mark.parametrize("m, n", [(1, 5), (2, 7), (3, 9), (5, 6)])
def test_exact_tail_equals_counting(m, n):
    for u in range(m * n + 1):
        assert p._exact_u_upper(u, m, n) == pytest.approx(counted_tail(u, m, n), rel=1e-14)


@pytest.mark.parametrize("n", [1_000, 3_000, 10_000, 10**7])
def test_exact_tail_of_large_samples(n):
    all_ways = math.comb(8 + n, 8)
    # of the largest values only the first few sums count: 1, 1, 2, 3, 5 partitions
    for short, ways in enumerate([1, 2, 4, 7, 12]):
        assert p._exact_u_upper(8 * n - short, 8, n) == ways / all_ways
    assert p._exact_u_upper(0, 8, n) == 1.0
    middle = p._exact_u_upper(4 * n, 8, n) + p._exact_u_upper(4 * n + 1, 8, n)
    assert middle == pytest.approx(1.0, abs=1e-15)
    assert p.mann_whitney_two_sided(8.0 * n, 8, n, 0)[1] == "exact"


def test_student_with_very_many_degrees_is_normal():
    for t in (0.5, 1.0, 2.5, 6.0):
        assert p.student_two_sided(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)

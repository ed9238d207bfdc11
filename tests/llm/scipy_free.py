"""A chi-square check without scipy."""


def chi_square_ok(values, cells):
    mean = len(values) / cells
    stat = sum((values.count(k) - mean) ** 2 / mean for k in range(cells))
    return stat < cells - 1 + 4 * (2 * (cells - 1)) ** 0.5

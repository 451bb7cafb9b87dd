"""Plain versions that operators are held against."""

import numpy as np


def density_labels(x, eps, min_points):
    """Labels of density clusters of the rows of x, in the order of their first core row; -1 for noise; border rows go to the earlier cluster."""
    near = [np.flatnonzero(((x - row) ** 2).sum(1) <= eps * eps) for row in x]
    core = np.array([len(n) >= min_points for n in near], bool)
    label, c = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], todo = c, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = c
                    if core[j]:
                        todo.append(j)
        c += 1
    return label

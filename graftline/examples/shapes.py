"""Example input: two functions that differ in their names only."""


class Box:
    def __init__(self, width, height):
        self.width = width
        self.height = height

    def area(self):
        total = self.width * self.height
        if total < 0:
            raise ValueError("negative")
        return total


def first_total(rows):
    result = 0
    for row in rows:
        if row > 10:
            result += row
    return result


def second_total(items):
    amount = 0
    for item in items:
        if item > 10:
            amount += item
    return amount

"""Readers of genotype files, and a simulator of populations."""

from lodestock.sources.genotype_files import read_plink, read_plink_raw, read_snp_lines, write_plink
from lodestock.sources.simulate import simulate_genotypes, simulate_population

__all__ = ["read_plink", "read_plink_raw", "read_snp_lines", "simulate_genotypes", "simulate_population", "write_plink"]
